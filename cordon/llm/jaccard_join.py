"""N-gram Jaccard self-join of documents by multiple-global-order prefix filtering.

A document's set is its distinct word shingles. Two sets link when
``100 * |x & y| >= percent * |x | y|`` (exact integers, no estimate). The result is
one row per document with the least ``doc_id`` reachable by links.

How the work is laid out

1. *Classes.* One scan fingerprints every set. Equal sets form a class, aggregated
   map-side, so a third of the corpus in one group of copies is one vertex.
2. *First order.* Tokens are ordered by (log2 of how often their bucket occurs, hash):
   counts cover all documents, and tokens that many documents share come last. If
   overlap >= A is needed, the first ``|x| - A + l`` tokens of x and ``|y| - A + l`` of y
   share at least ``l``; with ``l`` about 5 % of a set, chance sharers drop out.
   A class indexes ``|x| - ceil(t|x|) + l`` tokens.
3. *Candidate families.* Tokens that few classes index give pairs, which are counted and
   kept if they can reach ``l``. Tokens that many classes index give only one edge per
   member, never all pairs, and only for members that could reach ``l`` by such tokens alone: a
   token's classes are dealt to salted parts, members link to the least class of their part,
   and the parts' least classes to the least of all. The connected components of these
   edges are families: any two linked sets lie in one family.
4. *Other orders, verification.* A family's sets meet in units of bounded rows and
   bytes (large families: blocks within and between neighbouring length bands). In a unit a
   pair is a candidate only if it passes the ``l``-prefix filter under every further order
   too (the filters are intersected); candidates are verified exactly. A unit returns each
   member's number of links and one edge of a spanning forest.
5. *Components* of the links, then the least ``doc_id``.

Nothing is capped or sampled: long groups change the form of the edges, never the result.
Sets are compared by 64-bit fingerprints of shingles and of classes, so a wrong link
needs a collision of two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .components import components
from .tables import dropped, free, prepared, read, written
from .words import SPACE, mix, shingles, word_hashes

_U = np.uint64
#: Salts of the global orders; the first builds the index, the others filter in the units.
ORDERS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0))
#: Share of a set that two indexed prefixes must have in common, less one token.
EXTRA = 0.05
#: A token indexed by more classes than this gives star edges instead of pairs.
HOT = 64
#: Sets and tokens of one side of a verification unit.
UNIT_SETS, UNIT_TOKENS = 256, 2_000_000
#: Parts that a common token's classes are dealt to, at least; as many more as the root of thousands of tokens.
SALTS = 64
#: Rows up to which a list of documents to re-read or to drop is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def _least(n: int, percent: int) -> int:
    """ceil(percent / 100 * n)"""
    return -(-percent * n // 100)


def _share(n):
    return 1 + (n * EXTRA).astype(np.int64) if isinstance(n, np.ndarray) else 1 + int(n * EXTRA)


def _class_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        both = np.array([s.sum(dtype=_U), np.bitwise_xor.reduce(s)], dtype=_U)
        key = mix(mix(both[:1]) * _U(3) + mix(both[1:] + _U(len(s))))
    return int(key.view(np.int64)[0])


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, words in word_hashes(column, SPACE):
        yield row, np.unique(shingles(words, size))


def _order(s: np.ndarray, salt: np.uint64, classes: np.ndarray, shift: int) -> np.ndarray:
    """Rank of each token under one global order: frequent buckets last, then by hash."""
    heavy = classes[(s >> _U(shift)).astype(np.int64)].astype(_U)
    return (heavy << _U(58)) | (mix(s ^ salt) >> _U(6))


def _scan(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Row kind 0: a document's set size, class and hash of its text; kind 1: a task's token count per bucket."""
    names = ["kind", "doc_id", "n", "k", "th"]

    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            keys, sizes = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for row, s in _sets(batch.column(1), size):
                if len(s):
                    sizes[row], keys[row] = len(s), _class_key(s)
                    np.add.at(total, (s >> _U(64 - bits)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(keys), np.int8)), batch.column(0), pa.array(sizes), pa.array(keys, pa.int64()), batch.column(3)], names=names)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at: at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(part), np.int8)), pa.array(part), pa.array(total[part]), none := pa.nulls(len(part), pa.int64()), none], names=names)
    return docs.mapInArrow(run, "kind byte, doc_id long, n long, k long, th long")


def _index(docs: DataFrame, size: int, percent: int, classes, bits: int) -> DataFrame:
    """``(token, heavy, k, n)``: the indexed prefix tokens of every class under the first order."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out = []
            for _, s in _sets(batch.column(1), size):
                if not len(s) or (k := _class_key(s)) in seen:
                    continue
                seen.add(k)
                if len(seen) > 500_000:  # only saves repeats; equal rows are also merged later
                    seen.clear()
                n = len(s)
                p = min(n, n - _least(n, percent) + _share(n))
                rank = _order(s, ORDERS[0], classes.value, 64 - bits)
                pick = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
                out.append((s[pick].view(np.int64), rank[pick] >> _U(58) > 0, k, n))
            if out:
                lengths = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])),
                     pa.array(np.repeat([x[2] for x in out], lengths)), pa.array(np.repeat([x[3] for x in out], lengths).astype(np.int32))],
                    names=["token", "heavy", "k", "n"])
    return docs.mapInArrow(run, "token long, heavy boolean, k long, n int")


def _stars(starred: DataFrame, salts: int) -> DataFrame:
    """``(a, b)``: the classes of each token as one tree of two levels, so no task holds a token's classes as a whole."""
    dealt = starred.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(salts)))
    parts = written(dealt.groupBy("token", "part").agg(F.min("k").alias("a")), "parts")
    whole = parts.groupBy("token").agg(F.min("a").alias("first"), F.max("a").alias("last")).where("first <> last").select("token", "first")
    within = dealt.join(parts, ["token", "part"]).where("a <> k").select("a", F.col("k").alias("b"))
    between = parts.join(whole, "token").where("first <> a").select(F.col("first").alias("a"), F.col("a").alias("b"))
    return within.unionByName(between).distinct()


def _edges(index: DataFrame, percent: int, salts: int = SALTS) -> DataFrame:
    """Candidate edges ``(a, b)``: counted pairs of rare tokens, star edges of common ones."""
    token = W.partitionBy("token")
    # A token of no heavy bucket is in fewer sets than twice the mean bucket holds, so these groups are bounded.
    rare = (index.where("NOT heavy").select("token", "k", "n").repartition("token").dropDuplicates(["token", "k"])
            .withColumn("m", F.count("*").over(token)).where("m > 1"))
    rare = written(rare, "rare")
    few, many = rare.where(F.col("m") <= HOT).select("token", "k", "n"), rare.where(F.col("m") > HOT)
    hot = index.where("heavy").select("token", "k", "n").unionByName(many.select("token", "k", "n"))
    common = written(hot.groupBy("k").agg(F.count("*").alias("common"), F.first("n").alias("n")), "common")
    # A set whose common tokens alone can't reach l meets each linked set at a rare token too.
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) * EXTRA)
    # Pairs and stars are written one after the other: planned as one query, their scans and broadcasts are in the driver's memory at once.
    stars = written(_stars(hot.select("token", "k").join(common.where(F.col("common") >= least).select("k"), "k"), salts), "stars")
    x, y = few.select("token", F.col("k").alias("a"), F.col("n").alias("na")), few.select("token", F.col("k").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = written(x.join(y, "token").where(near).groupBy("a", "b")
                    .agg(F.count("*").alias("both"), F.first(F.least("na", "nb")).alias("n")), "pairs")
    dropped(rare)
    needs = 1 + F.floor(F.col("n") * EXTRA)
    # Only pairs that fall short by their rare tokens alone need the numbers of their common ones.
    enough = pairs.where(F.col("both") >= needs).select("a", "b")
    short = (pairs.where(F.col("both") < needs)
             .join(common.select(F.col("k").alias("a"), F.col("common").alias("ca")), "a")
             .join(common.select(F.col("k").alias("b"), F.col("common").alias("cb")), "b")
             .where(F.col("both") + F.least("ca", "cb") >= needs).select("a", "b"))
    return enough.unionByName(short).unionByName(stars)


def _gram(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of every two sets, by products of bounded 0/1 blocks."""
    m, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((m, m), np.float64)
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = max(256, (1 << 21) // m)
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], cross: np.ndarray, percent: int, classes: np.ndarray, shift: int) -> np.ndarray:
    """Which pairs of a unit link: length, then every further order's prefix filter, then the overlap itself."""
    n = np.array([len(s) for s in sets])
    small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
    ok = cross & (100 * small >= percent * large)
    for salt in ORDERS[1:]:
        if not ok.any():
            return ok
        prefix = []
        for s in sets:
            p = min(len(s), len(s) - _least(len(s), percent) + _share(len(s)))
            prefix.append(s[np.argpartition(_order(s, salt, classes, shift), p - 1)[:p]] if p < len(s) else s)
        ok &= _gram(prefix) >= 1 + (small * EXTRA).astype(np.int64)
    if not ok.any():
        return ok
    both = _gram(sets)
    return ok & (100 * both >= percent * (n[:, None] + n[None, :] - both))


def _verify(units: DataFrame, percent: int, classes, bits: int) -> DataFrame:
    """``(a, b, links)``: each member's links in the unit and an edge to the least class it reaches there."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["k", "side"])
        sets = [np.frombuffer(x, dtype=_U) for x in pdf["s"]]
        side, keys = pdf["side"].to_numpy(), pdf["k"].to_numpy()
        cross = side[:, None] != side[None, :] if pdf["two"].iloc[0] else ~np.eye(len(keys), dtype=bool)
        ok = linked(sets, cross, percent, classes.value, 64 - bits)
        label = keys.copy()
        while True:
            best = np.minimum(label, np.where(ok, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (best == label).all():
                break
            label = best
        links = ok.sum(axis=1)
        return pd.DataFrame({"a": keys, "b": label, "links": links})[links > 0]
    return units.groupBy("fam", "unit").applyInPandas(run, "a long, b long, links long")


def _units(members: DataFrame, percent: int) -> DataFrame:
    """``(k, fam, unit, side, two)``: where each member of a family is compared; ``two``: the unit meets two blocks.

    A small family is one unit. In a large one, a length band meets itself and the next
    band, block by block; every pair that the length filter admits meets in exactly one unit.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)))
    cells = members.withColumn("band", band).groupBy("fam", "band").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    whole = (cells.groupBy("fam").agg(F.sum("m").alias("fm"), F.sum("t").alias("ft"))
             .withColumn("one", (F.col("fm") <= UNIT_SETS) & (F.col("ft") <= UNIT_TOKENS)))
    small = members.join(whole.where("one AND fm > 1").select("fam"), "fam").select("k", "fam", F.lit("").alias("unit"), F.lit(0).alias("side"), F.lit(False).alias("two"))
    blocks = F.ceil(F.greatest(F.col("m") / UNIT_SETS, F.col("t") / UNIT_TOKENS)).cast("int")
    cells = cells.join(whole.where("NOT one").select("fam"), "fam").select("fam", "band", blocks.alias("blocks"))
    up = cells.select("fam", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    down = cells.select("fam", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    large = (members.withColumn("band", band).join(cells, ["fam", "band"]).join(up, ["fam", "band"], "left").join(down, ["fam", "band"], "left")
             .withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")))
    name = lambda b, i, c, j: F.concat_ws(".", b.cast("string"), i.cast("string"), c.cast("string"), j.cast("string"))
    seq = lambda n: F.when(n.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    b, i = F.col("band"), F.col("i")
    own = F.transform(seq(F.col("blocks")), lambda j: F.struct(name(b, F.least(i, j), b, F.greatest(i, j)).alias("unit"), F.when(i <= j, 0).otherwise(1).alias("side"), (i != j).alias("two")))
    above = F.transform(seq(F.col("up")), lambda j: F.struct(name(b, i, b + 1, j).alias("unit"), F.lit(0).alias("side"), F.lit(True).alias("two")))
    below = F.transform(seq(F.col("down")), lambda j: F.struct(name(b - 1, j, b, i).alias("unit"), F.lit(1).alias("side"), F.lit(True).alias("two")))
    large = large.select("k", "fam", F.explode(F.concat(own, above, below)).alias("u")).select("k", "fam", "u.unit", "u.side", "u.two")
    return small.unionByName(large)


def _bits(docs: DataFrame) -> int:
    """log2 of the number of count buckets: one per 2 KB of input, from 2**18 to 2**26."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(26, max(18, math.ceil(math.log2(max(size, 1) / 2048 + 1))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)``, one row per input row.

    ``n_links``: linked documents' different sets (copies of one set count once).
    Null or empty texts (no words) have no shingles, link with nothing and are their own
    component. A text shorter than ``size`` words is one shingle. Repeated rows and rows with
    a null id are rows like others; a component whose ids are all null has a null id. An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    return _found(docs, id_col, text_col, size, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def _found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """``jaccard_components`` with ``th``, the hash of the row's text, and ``c``, its component (null without words)."""
    spark = prepared(docs.sparkSession)
    # ``at`` finds a row's text again; rows without an id go by their text.
    own = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
           .withColumn("at", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("th", F.xxhash64("text")))
    bits = _bits(docs)
    scan = written(_scan(own, size, bits), "scan")
    buckets = scan.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n"))
    total = buckets.agg(F.sum("n")).first()[0] or 0
    # At most half of the buckets hold twice the mean: bounded by 2**25 pairs, at any corpus size.
    mean = max(1.0, total / (1 << bits))
    table = buckets.where(F.col("n") >= 2 * mean).toPandas()
    weights = np.zeros(1 << bits, np.uint8)
    weights[table["doc_id"].to_numpy(np.int64)] = np.minimum(np.floor(np.log2(table["n"].to_numpy(np.float64) / mean)), 63)
    classes = spark.sparkContext.broadcast(weights)

    signs = scan.where("kind = 0").select("doc_id", "n", "k", "th", F.coalesce("doc_id", "th").alias("at"))
    index = written(_index(own, size, percent, classes, bits), "index")
    families = components(_edges(index, percent, max(SALTS, math.isqrt(total // 1000)))).select(F.col("v").alias("k"), F.col("c").alias("fam"))
    sets = signs.where("k IS NOT NULL").groupBy("k").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("at").alias("at"))
    members = written(sets.join(families, "k"), "members")
    dropped(index)
    wanted = members.select("at", "k")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def gather(batches):
        for batch in batches:
            rows = [(k, s.tobytes()) for (_, s), k in zip(_sets(batch.column(0), size), batch.column(1).to_pylist(), strict=True)
                    if len(s) and _class_key(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "s"])

    texts = own.join(wanted, "at").select("text", "k").mapInArrow(gather, "k long, s binary")
    units = written(_units(members, percent), "units")  # a query of its own, like the pairs and stars of ``_edges``
    found = written(_verify(units.join(texts, "k"), percent, classes, bits), "links")
    dropped(units, members)
    classes.destroy()

    parts = components(found.where("a <> b").select("a", "b")).select(F.col("v").alias("k"), "c")
    degree = found.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("n_links"))
    reach = (sets.select("k", "doc_id").join(parts, "k", "left").withColumn("c", F.coalesce("c", "k")))
    least = reach.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = written(reach.join(least, "c").join(degree, "k", "left").select("k", "c", "component_id", "n_links"), "named")
    return (signs.join(named, "k", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), "th", "c"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with the least ``doc_id`` of each component kept (all columns, all rows without words).

    Row by row: where an id repeats, only its rows in a component of a lesser id go; rows that repeat the kept id stay.
    Rows without an id go where their component has one; of a component without any, one row stays (that of the least text hash).
    """
    text_col = how.get("text_col", "text")
    found = _found(docs, id_col, **how).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "component_id", "c").where("c IS NOT NULL")
    found = written(found.where("_id IS NULL OR _id <> component_id").distinct(), "copies")
    bare = found.where("_id IS NULL AND component_id IS NULL")
    kept = written(bare.groupBy("c").agg(F.min("_th").alias("_kept")).select("_kept"), "kept")
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t  # noqa: E731  texts needn't be shuffled for few rows
    own, text = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    gone = small(found.select("_id", "_th"))
    out = docs.join(gone, own.eqNullSafe(gone["_id"]) & (text == gone["_th"]), "left_anti")
    if kept.isEmpty():
        return out
    few = small(kept)
    key, row = free("_key", docs.columns), free("_row", docs.columns)
    one = (docs.join(few, own.isNull() & (text == few["_kept"]), "left_semi").select(text.alias(key), F.struct(*docs.columns).alias(row))
           .groupBy(key).agg(F.first(row).alias(row)).select(f"{row}.*"))
    return out.unionByName(one)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` at 4-word shingles and Jaccard 0.85."""
    return jaccard_components(read(spark, sf_dir, "documents"), size=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) END AS g FROM w),
c AS (SELECT min(doc_id) AS id, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT id, n, unnest(g) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id <> b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(id, v) AS (SELECT id, id FROM c UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.v),
m AS (SELECT id, min(v) AS component_id FROM r GROUP BY id),
d AS (SELECT a AS id, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN m ON m.id = c.id LEFT JOIN d ON d.id = c.id
"""
