"""Guarded arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_change(base, new) -> Column:
    """(new - base) * 100 / base, and 0 when base is not positive or null."""
    base, new = _col(base), _col(new)
    return F.when(base > 0, (new - base) * F.lit(100.0) / base).otherwise(F.lit(0.0))


def pct_of(part, whole) -> Column:
    """part * 100 / whole; null when whole is 0 (ANSI-safe)."""
    return F.try_divide(_col(part) * F.lit(100.0), _col(whole))


def pct_of_or_zero(part, whole) -> Column:
    """part * 100 / whole; 0 when whole is 0 or null."""
    return F.coalesce(pct_of(part, whole), F.lit(0.0))


def tip_pct(tip="tip_amount", fare="fare") -> Column:
    """Tip as a percentage of fare; 0 when fare is not positive or null."""
    tip, fare = _col(tip), _col(fare)
    return F.when(fare > 0, tip / fare * F.lit(100.0)).otherwise(F.lit(0.0))


def blend(a, b, wa: float, wb: float) -> Column:
    """coalesce(a, 0) * wa + coalesce(b, 0) * wb."""
    return (F.coalesce(_col(a).cast("double"), F.lit(0.0)) * F.lit(float(wa))
            + F.coalesce(_col(b).cast("double"), F.lit(0.0)) * F.lit(float(wb)))
