"""Language identification of web pages by fusing four sources of evidence with Bayes' rule.

``P(lang | page) ~ prior(lang | host) * P(text | lang) * P(declared | lang) * P(suffix | lang)``

* *Text*: multinomial over hashed byte trigrams of the visible text; trigram counts come from every labelled
  document (summed per task, then by a grouped aggregate).
* *Declared*: the ``lang`` attribute of ``<html>``; its confusion table is counted over all pages.
* *Suffix*: the last label of the host name, likewise.
* *Host prior*: counts per host, smoothed to the site (the host's last two labels), smoothed to all pages;
  a page's own vote is taken out of its host's and site's counts.

The tables count the pages' most likely language by text alone. All of them are grouped aggregates
combined before the shuffle, so a host with a third of all pages is one row of a small table.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .tables import prepared, read, written
from .words import PIECE, texts

#: Hash bins of trigrams; the text's log-likelihood counts as that of at most EVIDENCE trigrams (they aren't independent).
BINS, EVIDENCE = 1 << 14, 60.0
#: Weight of the wider table when a narrower one is smoothed to it.
TO_SITE, TO_ALL, TO_EVEN = 5.0, 5.0, 1.0
#: Languages, at most, that a label column may name (each has a row of BINS numbers in the broadcast model).
LANGUAGES = 500

_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_LOWER[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # every other ASCII character is one gap


def trigrams(data: np.ndarray) -> np.ndarray:
    """Count of each bin among the byte trigrams of a text; runs of gaps count as one. Pieces bound the memory."""
    out = np.zeros(BINS, np.int64)
    for at in range(0, len(data), PIECE):
        b = _LOWER[data[at: at + PIECE + 2]]
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b = b[keep]
        if len(b) > 2:
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            out += np.bincount(((code * 0x9E3779B1) >> 18) & (BINS - 1), minlength=BINS)
    return out


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log P(bin | language) from all rows with a label; null labels and texts teach nothing.

    Of more than ``LANGUAGES`` labels those with most text are languages (ties: the first names); the others teach nothing.
    """
    prepared(docs.sparkSession)

    def emit(total):
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bin", "n"])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for row, lang in enumerate(batch.column(1).to_pylist()):
                total[lang] = total.get(lang, 0) + trigrams(data[offsets[row]: offsets[row + 1]])
            if len(total) > LANGUAGES:  # dirty labels: what is held stays bounded
                yield from emit(total)
                total = {}
        yield from emit(total)

    counts = (docs.select(F.col(text_col).cast("string").alias("t"), F.lower(F.trim(lang_col)).alias("lang")).where("lang IS NOT NULL AND t IS NOT NULL AND lang <> ''")
              .mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    counts = written(counts, "trigrams")
    most = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    langs = sorted(r["lang"] for r in most.collect())
    counts = counts.join(F.broadcast(most.select("lang")), "lang", "left_semi")  # at most LANGUAGES rows
    table = np.full((len(langs), BINS), 0.5)
    found = counts.toPandas()
    place = {lang: k for k, lang in enumerate(langs)}
    np.add.at(table, (found["lang"].map(place).to_numpy(np.int64), found["bin"].to_numpy(np.int64)), found["n"].to_numpy(np.float64))
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def visible(html: Column) -> Column:
    """A page's text: comments, scripts, styles, its head and tags off, each in one pass.

    A comment, script or style that nothing closes runs to the page's end; an unclosed head stays text.
    """
    off = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*+>|\z)", " ")
    start = F.regexp_instr(off, F.lit(r"(?i)<head\b"))
    parts = F.split(F.substring(off, start, F.length(off)), r"(?i)</head\s*+>", 2)
    off = F.when((start > 0) & (F.size(parts) > 1), F.concat(F.substring(off, F.lit(1), start - 1), F.lit(" "), F.get(parts, F.lit(1)))).otherwise(off)
    return F.regexp_replace(off, r"<[^<>]*+>", " ")


def declared(html: Column) -> Column:
    """Main part of the ``lang`` attribute of the html element, in lower case; null if there is none."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^<>]*+)>", 1)
    found = F.lower(F.regexp_extract(tag, r"""(?is)(?:^|\s)(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,8})""", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, site, suffix, declared, n, ll)``: ll is the text's log-likelihood per language, worth at most EVIDENCE trigrams."""
    spark = prepared(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    host = host_of(F.col(url_col))
    site = F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), site.alias("site"), F.element_at(F.split(host, r"\."), -1).alias("suffix"),
                        declared(F.col(html_col)).alias("declared"), F.coalesce(visible(F.col(html_col)), F.lit("")).alias("text"))
    n_langs = len(langs)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = texts(batch.column(5))
            n, ll = [], []
            for row in range(batch.num_rows):
                c = trigrams(data[offsets[row]: offsets[row + 1]])
                total = int(c.sum())
                some = np.flatnonzero(c)
                own = m[:, some] @ c[some] if total else np.zeros(n_langs)
                n.append(total)
                ll.append((own * min(1.0, EVIDENCE / max(total, 1))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))], names=["page_id", "host", "site", "suffix", "declared", "n", "ll"])

    return rows.mapInArrow(run, "page_id long, host string, site string, suffix string, declared string, n long, ll array<double>")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """``(page_id, lang, probability, text_lang, declared, host)`` of the rows of ``evidence``."""
    k = len(langs)
    best = F.array_position("ll", F.array_max("ll")).cast("int")  # ties: the first language
    rows = written(rows.withColumn("t", F.when(F.col("n") > 0, best)), "evidence")
    voted = rows.where("t IS NOT NULL")

    def votes(key: str) -> DataFrame:
        cells = [F.sum((F.col("t") == j + 1).cast("long")).alias(f"_{j}") for j in range(k)]
        return written(voted.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"key_{key}")).agg(*cells).select(f"key_{key}", F.array(*[f"_{j}" for j in range(k)]).alias(f"by_{key}")), key)

    every = voted.agg(*[F.sum((F.col("t") == j + 1).cast("long")).alias(f"_{j}") for j in range(k)]).first()
    total = [int(every[j] or 0) for j in range(k)]
    hosts, sites, suffixes, marks = (votes(x) for x in ("host", "site", "suffix", "declared"))
    n_suffix, n_mark = max(1, suffixes.count()), max(1, marks.count())
    full = rows
    for name, table in (("host", hosts), ("site", sites), ("suffix", suffixes), ("declared", marks)):
        full = full.join(table, F.col(name) == F.col(f"key_{name}"), "left")

    at = lambda name, j: F.coalesce(F.col(f"by_{name}")[j], F.lit(0))
    size = lambda name: sum((at(name, j) for j in range(k)), F.lit(0))
    one = F.when(F.col("t").isNotNull(), 1).otherwise(0)
    scores = []
    for j in range(k):
        own = F.when(F.col("t") == j + 1, 1).otherwise(0)
        p_all = (total[j] + TO_EVEN) / (sum(total) + TO_EVEN * k)
        out = lambda name, own=own: F.when(F.col(f"by_{name}").isNotNull(), own).otherwise(0)
        p_site = (at("site", j) - out("site") + TO_ALL * p_all) / (size("site") - F.when(F.col("by_site").isNotNull(), one).otherwise(0) + TO_ALL)
        p_host = (at("host", j) - out("host") + TO_SITE * p_site) / (size("host") - F.when(F.col("by_host").isNotNull(), one).otherwise(0) + TO_SITE)
        s = F.log(p_host) + F.col("ll")[j]
        for name, kinds in (("declared", n_mark), ("suffix", n_suffix)):  # unknown values say nothing
            s = s + F.when(F.col(name).isNotNull(), F.log((at(name, j) + 1.0) / (total[j] + kinds + 1.0))).otherwise(0.0)
        scores.append(s)
    full = full.withColumn("s", F.array(*scores)).withColumn("top", F.array_max("s"))
    name = F.array(*[F.lit(x) for x in langs])
    weight = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return full.select("page_id", F.element_at(name, F.array_position("s", F.col("top")).cast("int")).alias("lang"), (1 / weight).alias("probability"),
                       F.when(F.col("t").isNotNull(), F.element_at(name, F.col("t"))).alias("text_lang"), "declared", "host")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: its most probable language (ties: first by name) and that probability.

    A page without text goes by the other evidence; null URLs have the prior of all pages; pages with nothing
    known get the commonest language. Repeated rows each vote. Without labelled documents the language is null.
    """
    langs, model = text_model(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    return fuse(evidence(pages, langs, model), langs)


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``pages``; the text model learns from all ``documents``."""
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
