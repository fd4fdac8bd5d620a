"""Mixing sources to target weights: a repetition rate per source, then whole copies plus one Bernoulli copy.

Built-in functions only. One aggregate gives each source's words; targets follow by
water-filling over that table (one row per source); every document then gets
``floor(rate)`` copies and one more with probability ``rate - floor(rate)``, drawn from
a hash of its id and a seed, so a rerun draws the same and no shuffle moves a text.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import free, read, written

#: Sources are weighed by these numbers in turn, in code point order, null last.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words; no source is repeated more often than CEILING.
SHARE, CEILING = 1.5, 2
#: Sources up to which the rates are broadcast (about 100 bytes each); beyond, a shuffled join.
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, source_size)``.

    A target is ``least(ceiling * size, level * weight)``, with the level at which the targets add
    up to ``share`` of all words: what a capped source leaves is shared by weight until none is
    above its cap. Sources without words have target and rate 0. The windows without a partition
    hold one row per source, never documents.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("w", pick).withColumn("cap", F.col("source_size") * ceiling)
         .withColumn("full", F.col("cap") / F.col("w")))  # the level at which the source is capped
    by = W.orderBy("full", F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("k", F.row_number().over(by)).withColumn("level", level)
    s = s.withColumn("at", F.min_by("level", F.when(F.col("level") <= F.col("full"), F.col("k"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("at") * F.col("w"))
    return (s.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
            .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key's text: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies`` (how often the mix takes the row).

    Null texts count 0 words; a null source is a source like others, ordered last. Rows with a
    null id draw by their text. Repeated rows draw alike. An empty table gives no rows. Where ``docs``
    has a column of an added name, the added one gets another underscore.
    """
    size, source_size, target, n, source, rate = (free(x, docs.columns) for x in ("_size", "_source_size", "_target", "_copies", "_source", "_rate"))
    sized = docs.withColumn(size, words(F.col(text_col)))
    table = written(rates(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size")), **how)
                    .select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate)), "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))
    whole = F.floor(rate)
    extra = (draw(key, seed) < F.col(rate) - whole).cast("int")
    return (sized.join(table, sized[source_col].eqNullSafe(table[source])).withColumn(n, (whole + extra).cast("int"))
            .drop(source, rate))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Every taken row as often as the mix takes it: the columns of ``docs`` and ``copy`` (from 1)."""
    n = free("_copies", docs.columns)
    taken = copies(docs, **how).where(F.col(n) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(free("copy", docs.columns)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return copies(read(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
      FROM d GROUP BY source),
f AS (SELECT *, (2 * s)::DOUBLE / w AS lim FROM s),
l AS (SELECT *, row_number() OVER o AS k,
        ((SELECT sum(s) FROM f)::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / ((SELECT sum(w) FROM f)::DOUBLE - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level
      FROM f WINDOW o AS (ORDER BY lim, source ASC NULLS LAST)),
t AS (SELECT source, s, CASE WHEN s > 0 THEN least((2 * s)::DOUBLE, (SELECT min_by(level, k) FROM l WHERE level <= lim) * w) ELSE 0.0::DOUBLE END AS target FROM l),
r AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.s AS source_size, r.target,
  (d.size * (floor(r.rate) + CASE WHEN ('0x' || substr(md5('0:' || d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                   < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
