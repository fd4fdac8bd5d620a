"""Report assembly: small result sets -> typed long rows, and one JSON document with numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sections of one row: the document renders them as {metric: value}.
FLAT_SECTIONS = ("rain_elasticity",)


def _numbered(df: DataFrame) -> DataFrame:
    """Rows numbered from 0 in their order; a section is a global aggregate or a top-k."""
    return (df.withColumn("_ord", F.monotonically_increasing_id())
            .withColumn("row", (F.row_number().over(Window.orderBy("_ord")) - 1).cast("int")).drop("_ord"))


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """Long table (section, row, metric, number, text) of already-aggregated results.

    Each section must be a bounded result (a global aggregate or a top-k), so
    numbering its rows in one partition is harmless. Every metric also gets a
    header row (row and values null), so a section with no rows still lists its columns.
    """
    parts = []
    for name, df in sections.items():
        numeric = {f.name: f.dataType.typeName() not in ("string", "date", "timestamp", "boolean") for f in df.schema.fields}
        cells = F.array(*[F.struct(F.lit(c).alias("metric"),
                                   (F.col(c) if numeric[c] else F.lit(None)).cast("double").alias("number"),
                                   (F.lit(None) if numeric[c] else F.col(c)).cast("string").alias("text")) for c in df.columns])
        long = _numbered(df).select(F.lit(name).alias("section"), "row", F.explode(cells).alias("c"))
        header = (df.sparkSession.range(1)
                  .select(F.lit(name).alias("section"), F.lit(None).cast("int").alias("row"),
                          F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("metric"),
                          F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text")))
        parts += [header, long.select("section", "row", "c.metric", "c.number", "c.text")]
    return reduce(DataFrame.unionByName, parts)


def report_json(sections: dict[str, DataFrame], flat_sections=FLAT_SECTIONS) -> DataFrame:
    """(section, json), one row per section: {metric: {row: value}} with values of the metric's own type.

    A flat section of one row renders as {metric: value}; a section without rows keeps its metrics.
    """
    parts = []
    for name, df in sections.items():
        by_row = [F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("row").cast("string"), F.col(c))))).alias(c)
                  for c in df.columns]
        one = _numbered(df).agg(*by_row)
        if name in flat_sections:
            one = one.select(*[F.col(c)["0"].alias(c) for c in df.columns])
        parts.append(one.select(F.lit(name).alias("section"),
                                F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")))
    return reduce(DataFrame.unionByName, parts)


def report_values(sections: DataFrame) -> DataFrame:
    """The rows of ``report_json`` read back from their text: (section, metric, row, kind, number, text).

    ``kind`` is the value's type in the document (number, text or null); flat sections have no row, and a metric without
    rows has one without kind.
    """
    metrics = sections.select("section", F.explode(F.from_json("json", "map<string,string>")).alias("metric", "inner"))
    nested = F.col("inner").startswith("{")
    cells = F.when(nested, F.from_json(F.when(nested, F.col("inner")), "map<string,variant>"))
    rows = metrics.select("section", "metric", "inner", nested.alias("nested"), F.explode_outer(cells).alias("row", "value"))
    # A flat value is taken from the document again: the map above has lost whether it was quoted.
    flat = sections.select("section", F.explode(F.from_json("json", "map<string,variant>")).alias("metric", "whole"))
    full = rows.join(flat, ["section", "metric"])
    value = F.when(F.col("nested"), F.col("value")).otherwise(F.col("whole"))
    out = full.select("section", "metric", F.col("row").cast("int").alias("row"), value.alias("v"), (F.col("nested") & F.col("row").isNull()).alias("empty"))
    kind = F.regexp_replace(F.schema_of_variant("v"), r"\(.*", "")
    kind = F.when(F.col("empty"), F.lit(None)).when(F.is_variant_null("v") | F.col("v").isNull(), F.lit("null")).when(kind == "STRING", F.lit("text")).otherwise(F.lit("number"))
    return (out.withColumn("kind", kind)
            .select("section", "metric", "row", "kind", F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).alias("number"),
                    F.when(F.col("kind") == "text", F.try_variant_get("v", "$", "string")).alias("text")))


def _json_string(c):
    """The JSON literal (quoted, escaped) of a string column."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'^\{"s":(.*)\}$', 1)


def report_document(sections: DataFrame) -> DataFrame:
    """One row, column ``json``: ``{"generated_at": ..., section: ..., ...}`` from the rows of ``report_json``."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("section", "json"))),
                          lambda e: F.concat(_json_string(e.getField("section")), F.lit(": "), e.getField("json")))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return sections.agg(F.concat(F.lit('{"generated_at": '), _json_string(stamp), F.lit(", "),
                                 F.array_join(members, ", "), F.lit("}")).alias("json"))
