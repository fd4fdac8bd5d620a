"""cordon: trip-audit analytics around a toll cordon, on Spark DataFrames.

Subpackages:
  sources    raw trip files, adapters, zone lookup, weather, file catalog
  functions  column expressions (time, guarded math, regression p-value)
  operators  flag, zone, profile, impute, weather, summary
  plans      the full run over materialised flagged trips, fused aggregate, report
  streaming  the row-local flag and daily counts on a stream
"""

__version__ = "0.1.0"
