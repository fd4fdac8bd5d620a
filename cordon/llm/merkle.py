"""Merkle dataset manifest: a content-addressed DAG over every row, and audit paths by descent from its root.

1. Rows become leaves (digests of their columns) and are ranked in their source by a range sort: ranges hold a bounded
   number of rows whatever the source sizes, and only one count per range is added up, so no task holds a source.
2. A tree is built bottom-up by runs of ``ARITY`` consecutive nodes. ``LEVELS`` levels go by one shuffle: the nodes below one
   page (``ARITY ** LEVELS`` at most) become a row (``digest``, ``records``) with all digest-to-children records of the page.
   Pages are the store, addressed by the digest of their top. The trees' roots, in source order, are leaves of a tree
   of the same kind.
3. Requests (tree, rank) descend from the root: a page joins by digest, the digits of the rank choose the child at every
   level, the unselected children make a path segment. Requests under one page share it, so upper pages are visited
   once however many leaves are asked for. Reversed, the segments are the audit path of the leaf.

Built-in functions only; each level of pages is a table in the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import read, written

#: Children of a node (the last run of a level may be shorter), and levels that a page holds.
ARITY, LEVELS = 3, 4
PAGE = ARITY**LEVELS
#: Rows of one range of the sort.
RANGE_ROWS = 200_000

SEGMENT = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


@dataclass
class Manifest:
    """``leaves`` (tree, rank, n, and the columns carried), ``trees`` (tree, source, n, digest), the pages and the root."""

    leaves: DataFrame
    trees: DataFrame
    top: DataFrame  # (tree, n, digest) of the tree over the trees
    pages: list[DataFrame]  # of the sources' trees, lowest first: (digest, records)
    top_pages: list[DataFrame]
    root: str | None


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (source, key, leaf, ...) with ``tree`` (rank of its source), ``rank`` in it and ``n``, its number of rows.

    Order: source, key (nulls first), leaf; rows alike in all three are interchangeable. Ranges may split a source
    and equal rows, so their sizes depend on the number of rows alone.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    order = [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    dealt = (rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_salt").sortWithinPartitions(*order)
             .drop("_salt").withColumn("_at", F.monotonically_increasing_id()))  # number of the range and row in it
    sorted_ = written(dealt, "sorted").withColumn("_range", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    spans = sorted_.groupBy("_range", "source").agg(F.count("*").alias("n"), F.min("_row").alias("first"))  # a row a range and one more a source
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = spans.groupBy("_range").agg(F.sum("n").alias("all")).select("_range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    spans = written(spans.join(offsets, "_range").withColumn("first", F.col("first") + F.col("offset")), "spans")
    sources = spans.groupBy("source").agg(F.sum("n").alias("n"), F.min(F.struct("first", "_range")).alias("at"))
    sources = sources.select("source", "n", F.col("at.first").alias("start"), F.col("at._range").alias("_range"))  # the range a source begins in
    begun = sources.groupBy("_range").agg(F.count("*").alias("all")).select("_range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("begun"))
    sources = sources.join(begun, "_range").select("source", "n", "start", (F.col("begun") + F.row_number().over(W.partitionBy("_range").orderBy("start")) - 1).alias("tree"))
    spans = spans.withColumnRenamed("source", "_source").select("_range", "_source", "offset")
    own = spans.join(sources, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_range").alias("_r"), "_source", "offset", "start", "n", "tree")
    full = sorted_.join(own, (F.col("_range") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_source")))
    return full.select("tree", (F.col("offset") + F.col("_row") - F.col("start")).alias("rank"), "n", *rows.columns)


def _depth(n: Column) -> Column:
    """Levels of a page in a tree that has ``n`` nodes below it."""
    return reduce(lambda c, k: c.when(n <= ARITY**k, F.lit(k)), range(1, LEVELS), F.when(n <= 1, F.lit(0))).otherwise(F.lit(LEVELS))


def _height(n: int) -> int:
    """Pages from the root of a tree of ``n`` leaves to a leaf."""
    h = 0
    while n > 1:
        n, h = -(-n // PAGE), h + 1
    return h


def built(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots ``(tree, digest)`` and pages per level from leaves ``(tree, rank, n, digest)``; a tree of one leaf is that leaf."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots, pages = [nodes.where("n = 1").select("tree", "digest")], []
    for level in range(_height(most)):
        below = nodes.where("n > 1").groupBy("tree", F.floor(F.col("rank") / PAGE).alias("rank")).agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("kids"))  # PAGE nodes at most

        def run_of(last: Column, i: Column) -> Column:
            kids = F.transform(F.slice(last, i * ARITY + 1, F.lit(ARITY)), lambda x: x["digest"])
            return F.struct(F.sha2(F.array_join(kids, ""), 256).alias("digest"), kids.alias("children"))

        def above(layers: Column, _: Column) -> Column:
            last = F.element_at(layers, -1)
            return F.concat(layers, F.array(F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / ARITY).cast("int")), lambda i: run_of(last, i))))

        first = F.array(F.transform("kids", lambda x: F.struct(x["digest"].alias("digest"), F.array().cast("array<string>").alias("children"))))
        layers = below.withColumn("layers", F.aggregate(F.sequence(F.lit(1), _depth(F.col("n"))), first, above))
        made = layers.select("tree", "rank", F.ceil(F.col("n") / PAGE).alias("n"), F.element_at("layers", -1)[0]["digest"].alias("digest"),
                             F.map_from_entries(F.array_distinct(F.flatten(F.slice("layers", F.lit(2), F.lit(LEVELS))))).alias("records"))
        made = written(made, f"{name}-{level}")
        pages.append(made.select("digest", "records"))
        nodes = made.select("tree", "rank", "n", "digest")
        roots.append(nodes.where("n = 1").select("tree", "digest"))
    return reduce(DataFrame.unionByName, roots), pages


def _walk(records: Column, top: Column, depth: Column, place: Column) -> Column:
    """(digest, path) of the node at ``place`` below a page: the digits of ``place``, highest first, choose the children."""

    def down(at: Column, power: Column) -> Column:
        d = (F.floor(place / power) % ARITY).cast("int")
        one = F.transform(F.array(F.element_at(records, at["digest"])), lambda kids: F.struct(
            kids[d].alias("digest"),
            F.concat(at["path"], F.array(F.struct(F.array_join(F.slice(kids, F.lit(1), d), "").alias("left"), F.array_join(F.slice(kids, d + 2, F.lit(ARITY)), "").alias("right")))).alias("path")))
        return one[0]

    powers = F.slice(F.array(*[F.lit(ARITY**k) for k in reversed(range(LEVELS))]), F.lit(LEVELS + 1) - depth, depth)
    return F.aggregate(powers, F.struct(top.alias("digest"), F.array().cast(SEGMENT).alias("path")), down)


def descended(requests: DataFrame, roots: DataFrame, pages: list[DataFrame], carry: list[str]) -> DataFrame:
    """``(tree, rank, *carry, digest, path, root)`` of every different request ``(tree, rank, *carry)``.

    ``roots``: (tree, n, digest, path), where the path so far is carried on. ``carry`` has to follow from the leaf, so
    that a page has ``PAGE`` different requests at most. Requests of no leaf return nothing.
    """
    start = roots.select("tree", "n", F.col("digest").alias("root"), "digest", "path", F.lit(0).cast("long").alias("page"))
    height = reduce(lambda c, k: c.when(F.col("n") <= PAGE**k, F.lit(k)), range(1, len(pages)), F.when(F.col("n") <= 1, F.lit(0))).otherwise(F.lit(len(pages)))
    start = start.withColumn("height", height)
    front = start.where(F.col("height") == len(pages))
    for level in reversed(range(len(pages))):
        kept = carry if level == 0 else []
        wants = requests.select("tree", F.floor(F.col("rank") / PAGE ** (level + 1)).alias("page"), F.struct((F.floor(F.col("rank") / PAGE**level) % PAGE).alias("place"), *kept).alias("want"))
        wants = wants.groupBy("tree", "page").agg(F.collect_set("want").alias("wants"))  # PAGE different ones at most
        store = pages[level].groupBy(F.col("digest").alias("key")).agg(F.any_value("records").alias("records"))  # equal subtrees are one page
        here = front.join(wants, ["tree", "page"]).join(store, F.col("digest") == F.col("key"))
        below = F.ceil(F.col("n") / PAGE**level)  # nodes of this tree below its pages of this level
        walked = F.transform(F.filter("wants", lambda w: F.col("page") * PAGE + w["place"] < below),
                             lambda w: F.struct(w.alias("want"), _walk(F.col("records"), F.col("digest"), _depth(below), w["place"]).alias("to")))
        here = here.select("tree", "n", "root", F.col("path").alias("head"), "page", F.explode(walked).alias("w"))
        front = here.select("tree", "n", "root", F.col("w.to.digest").alias("digest"), F.concat("head", "w.to.path").alias("path"),
                            (F.col("page") * PAGE + F.col("w.want.place")).alias("page"), *[F.col(f"w.want.{c}").alias(c) for c in kept])
        if level:
            front = front.unionByName(start.where(F.col("height") == level).drop("height"))
    names = ["tree", F.col("page").alias("rank"), *carry, "digest", "path", "root"]
    alone = start.where("height = 0").drop("height").join(requests.where("rank = 0").select("tree", *carry).distinct(), "tree").select(*names)
    return front.select(*names).unionByName(alone) if pages else alone


def manifest(docs: DataFrame, columns: list[str], key_col: str = "doc_id", source_col: str = "source", **carry: Column) -> Manifest:
    """The DAG over all rows of ``docs``: leaves hash ``columns``; ``carry`` names further columns kept beside the leaf.

    Null values are ``-``; null keys come first in their source, null is the first source; repeated rows are leaves of
    their own, side by side. An empty table has no tree and root None.
    """
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(key_col).alias("key"), leaf([F.col(c) for c in columns]).alias("leaf"), *[c.alias(k) for k, c in carry.items()])
    leaves = written(ranked(written(rows, "leaves")), "ranked")
    roots, pages = built(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), "pages")
    sizes = leaves.where("rank = 0").select("tree", "source", "n")
    trees = written(sizes.join(roots, "tree").withColumn("forest", F.lit(0).cast("long")), "trees")
    of_all = trees.count()
    top, top_pages = built(trees.select(F.col("forest").alias("tree"), F.col("tree").alias("rank"), F.lit(of_all).cast("long").alias("n"), "digest"), "top")
    top = written(top.withColumn("n", F.lit(of_all).cast("long")), "root")
    one = top.first()
    return Manifest(leaves, trees, top, pages, top_pages, one and one["digest"])


def proofs(m: Manifest, requests: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(tree, rank, *carry, leaf, subroot, path)``: what stands at each requested rank, and its audit path to the root.

    A path lists, from the leaf up, the unselected children of each run left and right of the selected node.
    """
    asked = requests.select("tree").distinct().join(m.trees.select("tree", "forest"), "tree").select(F.col("forest").alias("tree"), F.col("tree").alias("rank"))
    heads = descended(asked, m.top.select("tree", "n", "digest", F.array().cast(SEGMENT).alias("path")), m.top_pages, [])
    heads = heads.select(F.col("rank").alias("tree"), "digest", "path").join(m.trees.select("tree", "n"), "tree")
    found = descended(requests, heads, m.pages, list(carry))
    return found.select("tree", "rank", *carry, F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.reverse("path").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its audit path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and audit path of all ``documents``, and whether each row, some with line breaks deleted, still verifies."""
    docs = read(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = leaf([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS])
    m = manifest(docs, COLUMNS, tampered=F.when(even, cut))
    asked = m.leaves.select("tree", "rank", F.col("key").alias("doc_id"), "tampered")
    found = proofs(m, asked, ("doc_id", "tampered"))
    root = F.lit(m.root).cast("string")
    out = found.select("doc_id", "leaf", "subroot", root.alias("root"), siblings(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) & 1 AS odd,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
e AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN odd = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM d),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM e),
up AS (SELECT s, 0 AS lv, k, n, leaf AS h FROM l
  UNION ALL SELECT s, lv + 1, k // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM up WHERE n > 1 GROUP BY s, lv, k // 3),
top AS (SELECT 0 AS lv, s AS k, count(*) OVER () AS n, h FROM up WHERE n = 1
  UNION ALL SELECT lv + 1, k // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM top WHERE n > 1 GROUP BY lv, k // 3),
f AS (SELECT s, k AS k0, 0 AS lv, k, coalesce(other, leaf) AS h, '' AS sib, l.n FROM l
  UNION ALL SELECT f.s, k0, f.lv + 1, any_value(f.k) // 3, sha256(string_agg(CASE WHEN up.k = f.k THEN f.h ELSE up.h END, '' ORDER BY up.k)),
    any_value(sib) || coalesce(string_agg(up.h, '' ORDER BY up.k) FILTER (up.k <> f.k), ''), (any_value(f.n) + 2) // 3
  FROM f JOIN up ON up.s = f.s AND up.lv = f.lv AND up.k // 3 = f.k // 3 WHERE f.n > 1 GROUP BY f.s, k0, f.lv),
g AS (SELECT s, k0, 0 AS lv, s AS k, h, sib, (SELECT max(s) + 1 FROM l) AS n FROM f WHERE n = 1
  UNION ALL SELECT g.s, k0, g.lv + 1, any_value(g.k) // 3, sha256(string_agg(CASE WHEN top.k = g.k THEN g.h ELSE top.h END, '' ORDER BY top.k)),
    any_value(sib) || coalesce(string_agg(top.h, '' ORDER BY top.k) FILTER (top.k <> g.k), ''), (any_value(g.n) + 2) // 3
  FROM g JOIN top ON top.lv = g.lv AND top.k // 3 = g.k // 3 WHERE g.n > 1 GROUP BY g.s, k0, g.lv)
SELECT l.doc_id, l.leaf, sub.h AS subroot, root.h AS root, sha256(g.sib) AS proof_sha256, g.h AS folded_root, g.h = root.h AS verified
FROM l JOIN g ON g.s = l.s AND g.k0 = l.k AND g.n = 1 JOIN (SELECT s, h FROM up WHERE n = 1) sub ON sub.s = l.s, (SELECT h FROM top WHERE n = 1) root
"""
