"""Small helpers: build unified trip frames from tuples."""

import datetime as dt

from cordon.sources.trips import UNIFIED_SCHEMA


def ts(s):
    return dt.datetime.fromisoformat(s) if s is not None else None


def trips(spark, rows):
    """rows: dicts with any unified columns; others default."""
    defaults = dict(pickup_time=None, dropoff_time=None, pickup_loc=1, dropoff_loc=1,
                    trip_distance=1.0, fare=10.0, total_amount=12.0,
                    congestion_surcharge=0.0, tip_amount=0.0, taxi_type="yellow", vendor_id=1)
    out = []
    for r in rows:
        d = dict(defaults, **r)
        d["pickup_time"] = ts(d["pickup_time"]) if isinstance(d["pickup_time"], str) else d["pickup_time"]
        d["dropoff_time"] = ts(d["dropoff_time"]) if isinstance(d["dropoff_time"], str) else d["dropoff_time"]
        out.append(tuple(d[f.name] for f in UNIFIED_SCHEMA.fields))
    return spark.createDataFrame(out, UNIFIED_SCHEMA)
