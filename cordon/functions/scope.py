"""Partition pruning for tables partitioned by pickup year and month (or by year alone).

Operators filter on ``pickup_time`` ranges; Spark cannot turn those into
partition filters by itself. ``scope`` adds the equivalent predicates on the
partition columns when they exist, and does nothing on other frames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope(df: DataFrame, years: Iterable[int] | None = None,
          months: Iterable[int] | None = None, min_year: int | None = None) -> DataFrame:
    cols = set(df.columns)
    if "pickup_year" in cols:
        if years is not None:
            df = df.filter(F.col("pickup_year").isin([int(y) for y in years]))
        if min_year is not None:
            df = df.filter(F.col("pickup_year") >= int(min_year))
    if "pickup_month" in cols and months is not None:
        df = df.filter(F.col("pickup_month").isin([int(m) for m in months]))
    return df
