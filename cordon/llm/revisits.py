"""Not-modified revisits of a web archive: an as-of join by canonical URL to the latest earlier full response.

Built-in functions only. Records are dealt by ranges of (URL, time, id) that hold a bounded number of rows each, whatever
a URL's share of them and however its captures are spread in time: a URL with a third of all records gets many slices. Each
slice sorts its own records, and a small table of one row per slice carries the last responses of a URL's earlier slices
forward. Only (URL, time, id) takes part; headers follow by an equality join on the response's id.
"""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import read, written

#: Records of a slice, about.
SLICE = 50_000
#: Fields of a stored response that a not-modified answer must not replace, in lower case (fixed values).
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
        "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical(url: Column) -> Column:
    """Scheme, user, ``www.``, default port, fragment, tracking parameters and trailing slashes off; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^utm_")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit(""))))


def _plain(tag: Column) -> Column:
    """A validator without its weakness mark."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest_before(records: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``(id, response_id)`` for every revisit of ``(id, key, ts, full)``: the latest full record of its key with a smaller ts.

    Ties in ts go to the larger id; a revisit with a null key or ts, or without an earlier response, gets null.
    """
    timed = records.where("key IS NOT NULL AND ts IS NOT NULL").select("id", "key", "ts", "full")
    slices = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(timed.count() / slice_rows))
    sliced = written(timed.repartitionByRange(slices, "key", "ts", "id").withColumn("slice", F.spark_partition_id()), "sliced")
    point = F.when(F.col("full"), F.struct("ts", "id"))
    earlier = W.partitionBy("key", "slice").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    sliced = written(sliced.withColumn("own", F.max(point).over(earlier)), "own")
    # Of keys in several slices: first and last time, last response, and the last one before the last time.
    per = (sliced.groupBy("key", "slice").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max(point).alias("last"), F.max_by("own", "ts").alias("sooner"))
           .withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1"))
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"any": F.max("last").over(before), "less": F.max("sooner").over(before)})
    # A slice may begin within a moment that an earlier one holds records of: for its first time only what is older counts.
    nothing = F.lit(None)
    events = per.select("key", F.col("hi").alias("t"), F.col("last").alias("point"), nothing.cast("int").alias("slice")).unionByName(
        per.select("key", F.col("lo").alias("t"), nothing.cast("struct<ts:long,id:long>").alias("point"), "slice"))
    older = events.withColumn("older", F.max("point").over(W.partitionBy("key").orderBy("t").rangeBetween(W.unboundedPreceding, -1))).where("slice IS NOT NULL")
    carried = per.join(older.select("key", "slice", "older"), ["key", "slice"]).select("key", "slice", "lo", "any", F.greatest("less", "older").alias("older"))
    found = sliced.where("NOT full").join(carried, ["key", "slice"], "left")
    return found.select("id", F.coalesce("own", F.when(F.col("ts") > F.col("lo"), F.col("any")).otherwise(F.col("older")))["id"].alias("response_id"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit of ``records`` with the response it repeats.

    ``records``: id long (unique), url, ts long, full boolean, headers map (lower-case names), digest, length. Result: id, url_key,
    response_id, age (seconds since that response), verdict, headers (of the response with the permitted fields of
    the revisit, as sorted lines), digest, length.

    Verdict: ``etag`` or ``last-modified`` (that validator agrees; an entity tag counts first, and weak tags compare as
    strong ones), ``mismatch`` (it differs), ``unchecked`` (the revisit names none), ``missing`` (no earlier response; also for
    null URLs and times). Headers, digest and length are null for ``mismatch`` and ``missing``. Of records
    under one id the one with the least time counts (then url, full, digest, length, headers; null first); an empty table gives no rows; a null ``full`` means a revisit.
    """
    r = records.select("id", "url", "ts", F.coalesce("full", F.lit(False)).alias("full"), "headers", "digest", "length")
    order = F.struct("ts", "url", "full", "digest", "length", F.array_sort(F.map_entries("headers")))
    r = r.groupBy("id").agg(F.min_by(F.struct(*r.columns[1:]), order).alias("r")).select("id", "r.*").withColumn("key", canonical(F.col("url")))
    r = written(r, "records")
    asof = latest_before(r.select("id", "key", "ts", "full"))
    stored = r.where("full").select(F.col("id").alias("response_id"), F.col("ts").alias("rts"), F.col("headers").alias("rh"),
                                    F.col("digest").alias("rd"), F.col("length").alias("rl"))
    full = r.where("NOT full").select("id", "key", "ts", "headers").join(asof, "id", "left").join(stored, "response_id", "left")
    empty = F.create_map().cast("map<string,string>")
    new, old = F.coalesce("headers", empty), F.coalesce("rh", empty)
    tag, date = _plain(new["etag"]), new["last-modified"]
    verdict = (F.when(F.col("response_id").isNull(), "missing")
               .when(tag.isNotNull(), F.when(tag == _plain(old["etag"]), "etag").otherwise("mismatch"))
               .when(date.isNotNull(), F.when(date == old["last-modified"], "last-modified").otherwise("mismatch"))
               .otherwise("unchecked"))
    fresh = F.map_filter(new, lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(fresh, k), F.lit(False))), fresh)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    good = F.col("verdict").isin("etag", "last-modified", "unchecked")
    return (full.withColumn("verdict", verdict)
            .select("id", F.col("key").alias("url_key"), "response_id", (F.col("ts") - F.col("rts")).alias("age"), "verdict",
                    F.when(good, lines).alias("headers"), F.when(good, F.col("rd")).alias("digest"), F.when(good, F.col("rl")).alias("length")))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records that ``pages`` stand for: three per page.

    3k: the page's full response at second 7k (k its id), tagged by its content. 3k+1: five seconds later a not-modified answer for
    the same address in another spelling, with that tag. 3k+2: the host's front page, three seconds after the page; every
    fourth is a full response, the others not-modified answers, tagged by a version that changes every 8 ids.
    """
    k, tag = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    version = F.concat(F.lit('"v'), F.floor(k / 8).cast("string"), F.lit('"'))
    s = lambda x: x.cast("string")
    length = F.length(F.coalesce("html", F.lit(""))).cast("long")
    page = F.struct((k * 3).alias("id"), F.col("url").alias("url"), (k * 7).alias("ts"), F.lit(True).alias("full"),
                    F.create_map(F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("content-length"), s(length), F.lit("date"), s(k * 7), F.lit("server"), F.lit("a")).alias("headers"),
                    tag.alias("digest"), length.alias("length"))
    again = F.struct((k * 3 + 1).alias("id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), (k * 7 + 5).alias("ts"), F.lit(False).alias("full"),
                     F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), tag, F.lit('"')), F.lit("content-length"), F.lit("0"), F.lit("date"), s(k * 7 + 5), F.lit("age"), F.lit("5")).alias("headers"),
                     F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"))
    first = k % 4 == 0
    front = F.struct((k * 3 + 2).alias("id"), F.concat(F.lit("https://"), host, F.lit("/")).alias("url"), (k * 7 + 3).alias("ts"), first.alias("full"),
                     F.create_map(F.lit("etag"), version, F.lit("date"), s(k * 7 + 3)).alias("headers"),
                     F.when(first, F.md5(version)).alias("digest"), F.when(first, F.lit(100).cast("long")).alias("length"))
    return pages.where("page_id IS NOT NULL").select(F.explode(F.array(page, again, front)).alias("r")).select("r.*")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of all ``pages``."""
    return resolve(captures(read(spark, sf_dir, "pages")))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id AS k, url, md5(coalesce(html, '')) AS tag, length(coalesce(html, ''))::BIGINT AS n,
             regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, '"v' || (page_id // 8) || '"' AS version FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT k * 3 AS id, url, k * 7 AS ts, true AS f, '"' || tag || '"' AS etag, ['content-length: ' || n, 'date: ' || (k * 7), 'server: a'] AS rest, tag AS digest, n AS length FROM p
  UNION ALL SELECT k * 3 + 1, regexp_replace(url, '#.*$', '') || '#again', k * 7 + 5, false, '"' || tag || '"', ['age: 5', 'date: ' || (k * 7 + 5)], NULL, NULL FROM p
  UNION ALL SELECT k * 3 + 2, 'https://' || host || '/', k * 7 + 3, k % 4 = 0, version, ['date: ' || (k * 7 + 3)],
    CASE WHEN k % 4 = 0 THEN md5(version) END, CASE WHEN k % 4 = 0 THEN 100::BIGINT END FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS h,
        regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q FROM b),
d AS (SELECT *, h || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM c),
j AS (SELECT v.id, v.key, v.ts, v.etag AS vt, v.rest AS vr, max(struct_pack(ts := s.ts, id := s.id)) AS hit
      FROM d v LEFT JOIN d s ON s.f AND s.key = v.key AND s.ts < v.ts WHERE NOT v.f GROUP BY ALL),
m AS (SELECT j.*, s.etag AS st, s.rest AS sr, s.digest, s.length,
        CASE WHEN s.id IS NULL THEN 'missing' WHEN vt = s.etag THEN 'etag' ELSE 'mismatch' END AS verdict FROM j LEFT JOIN d s ON s.id = j.hit.id)
SELECT id, key AS url_key, hit.id AS response_id, ts - hit.ts AS age, verdict,
  CASE WHEN verdict = 'etag' THEN array_to_string(list_sort(list_concat(
    list_filter(list_append(sr, 'etag: ' || st), lambda x: split_part(x, ': ', 1) NOT IN ('etag', 'date', 'age')),
    list_append(vr, 'etag: ' || CASE WHEN id % 3 = 1 THEN 'W/' ELSE '' END || vt))), chr(10)) END AS headers,
  CASE WHEN verdict = 'etag' THEN digest END AS digest, CASE WHEN verdict = 'etag' THEN length END AS length
FROM m
"""
