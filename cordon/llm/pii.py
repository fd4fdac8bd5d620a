"""Personal data: fixed patterns, and bootstrapped contextual extraction of further identifiers.

1. One scan finds the base spans (email, ip, card, phone) of every whole text, and *candidates*:
   other runs of six or more letters, digits and ``._%+@:/#-`` that hold a digit and begin and end with a
   letter or digit. Spans and candidates both emit the lexical patterns around them: the word before, the two
   words before, the word before with the one after. Values and words are hashed whole, however long.
2. Base spans are the seed instances. Patterns and instances form a graph, of which only what seeds can reach is
   kept. Spark scores it in rounds: a pattern's confidence is the confidence-weighted number of its occurrences
   over how often its context occurs in all texts (a second scan counts that, whatever fills the slot); an
   instance's is ``1 - prod(1 - confidence)`` over its patterns. Newly trusted instances support further patterns
   in the next round; rounds go on until no confidence rises.
3. Candidate occurrences whose instance reaches ``TRUST`` become spans of kind ``context``.
4. Patterns that reach ``OPEN`` also find words of any shape: handles without a digit, short codes. Such a word
   must be particular to these contexts: one of its parts between punctuation has at least ``OWN`` of all its
   occurrences there, so an everyday word that strays into a slot stays. This takes two more scans, and none
   where no pattern is so sure.

A scan that counts keys carries a bit filter of them, of bounded size; what passes is summed and joined with the
keys themselves, so a crowded filter costs shuffled rows, never a result.

Only occurrences travel in shuffles, never texts; all sums are combined before shuffling, so a frequent
context is no hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .tables import dropped, free, prepared, read, written
from .words import PUNCT, SPACE, pieces, shingles, word_hashes, words_at

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match of [0-9]+(\.[0-9]+){3} always starts and ends its runs of digits; said so, long runs take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+@:/#-]{4,}[A-Za-z0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A pattern needs this weight of distinct instances, a trusted instance this confidence.
SUPPORT, TRUST = 3, 0.5
#: A pattern of this confidence finds words of any shape, if this share of a word's occurrences is in such patterns.
OPEN, OWN = 0.8, 0.5
#: Rounds end when no confidence rises by more than this.
SETTLED = 1e-6
#: log2 of the bits of a filter of keys: 256 bits a key or more, from 32 KB to 64 MB.
LEAST_BITS, MOST_BITS = 18, 29
#: Different keys that a task sums up before it hands them on.
HELD = 1_000_000
#: Rows with discovered spans up to which they are broadcast for masking.
BROADCAST_ROWS = 500_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """EMAIL's leftmost matches; starts from each @, so long texts without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, by start, then kind; code points."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]  # int() takes no part of thousands of digits
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that look like identifiers and touch no base span."""
    if not DIGIT.search(text):
        return []
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        if not DIGIT.search(m.group()):
            continue
        while k < len(taken) and taken[k][2] <= m.start():
            k += 1
        if not any(a < m.end() and b > m.start() for a, _, b in taken[k: k + 8]):
            out.append(m.span())
    return out


_SALT = np.array([0x51ED270B, 0x2545F491, 0x9E3779B9], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a text with a word, and the code points at which they start."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = [(w, at + a) for a, b in pieces(data, SPACE) for w, at in [words_at(data[a:b], SPACE)]]
    w, starts = (np.concatenate([f[k] for f in found]) for k in range(2))
    if len(data) != len(text):
        starts = np.cumsum((data & 0xC0) != 0x80)[starts] - 1
    return w, starts


def patterns(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Hashes of the patterns around each ``(start, end)``: word before, two words before, before and after.

    The text next to the span up to white space belongs to it, so words are whole.
    """
    if not spans:
        return []
    w, starts = _words(text)
    bounds = np.array(spans, np.int64)
    own = np.searchsorted(starts, bounds[:, 0], "right") - 1  # the word in which a span starts
    after = np.searchsorted(starts, bounds[:, 1])
    one, two = shingles(w, 1), shingles(w, 2)
    both = (own >= 1) & (after < len(w))
    around = np.zeros(len(spans), np.uint64)
    if both.any():
        around[both] = shingles(np.stack([w[own[both] - 1], w[after[both]]], axis=1).ravel(), 2)[::2]
    out = []
    for k, at in enumerate(own):
        hashes = [one[at - 1] ^ _SALT[0]] if at >= 1 else []
        if both[k]:
            hashes.append(around[k] ^ _SALT[2])
        if at >= 2:
            hashes.append(two[at - 2] ^ _SALT[1])
        out.append((np.array(hashes, np.uint64) * _SPREAD).view(np.int64).tolist())
    return out


def contexts(w: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(first, hashes)`` of each sort of pattern: hash k is that of the pattern around word ``first + k`` alone."""
    out = [(1, shingles(w, 1)[:-1] ^ _SALT[0])] if len(w) > 1 else []
    if len(w) > 2:
        out.append((2, shingles(w, 2)[:-1] ^ _SALT[1]))
        out.append((1, shingles(np.stack([w[:-2], w[2:]], axis=1).ravel(), 2)[::2] ^ _SALT[2]))
    return [(first, h * _SPREAD) for first, h in out]


def _instance(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.lower().encode(), digest_size=8).digest(), "little", signed=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a row key: rows that repeat a text under one id share it, and so their spans."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .withColumn("at", F.xxhash64("doc_id", "text")))


def _scan(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.list_(pa.int64())), ("base", pa.string()), ("sha", pa.string()),
                        ("seen", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("i", pa.int64()), ("patterns", pa.list_(pa.int64()))])))])

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                spans = base_spans(text)
                base = joined(spans)
                places = [(a, b, k) for a, k, b in spans] + [(a, b, 4) for a, b in candidates(text, spans)]
                seen = [{"start": a, "end": b, "kind": kind, "i": _instance(text[a:b]), "patterns": around}
                        for (a, b, kind), around in zip(places, patterns(text, [p[:2] for p in places]), strict=True)]
                out.append({"doc_id": doc_id, "at": at, "n": [sum(k == one for _, k, _ in spans) for one in range(4)], "base": base,
                            "sha": hashlib.sha256(base.encode()).hexdigest(), "seen": seen})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, "doc_id long, at long, n array<long>, base string, sha string, seen array<struct<start:int,end:int,kind:tinyint,i:bigint,patterns:array<bigint>>>")


@dataclass
class Filter:
    """Two bits for every key, at its leading and at its last bits; few other keys find both set."""

    bits: np.ndarray
    log: int

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in (keys >> np.uint64(64 - self.log), keys & np.uint64((1 << self.log) - 1)):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def key_filter(keys: DataFrame, column: str) -> Filter:
    """The filter of a column of hashes, put together from Spark's own bitmaps of 4 KB."""
    log = min(MOST_BITS, max(LEAST_BITS, (256 * keys.count()).bit_length()))
    place = F.col("place") + 1  # positions of a bitmap count from 1
    both = F.array(F.shiftrightunsigned(column, 64 - log), F.col(column).bitwiseAND(F.lit((1 << log) - 1)))
    parts = keys.where(F.col(column).isNotNull()).select(F.explode(both).alias("place")).groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    bits = np.zeros((1 << log) // 8, np.uint8)
    for n, b in parts.toLocalIterator():
        bits[(n - 1) * 4096: n * 4096] = np.frombuffer(b, np.uint8)
    return Filter(bits, log)


def _tally(rows: DataFrame, keys: DataFrame, column: str, separators: bytes, hashes: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """``(column, total)``: how often each of ``keys`` is among ``hashes`` of the words of all texts."""
    shared = rows.sparkSession.sparkContext.broadcast(key_filter(keys, column))

    def run(batches):
        chosen, held = shared.value, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            found = [h[chosen.passes(h)] for _, w in word_hashes(batch.column(0), separators) for h in hashes(w)]
            found = np.concatenate(found or [np.zeros(0, np.uint64)])
            some, at = np.unique(np.concatenate([held[0], found]), return_inverse=True)
            total = np.zeros(len(some), np.int64)
            np.add.at(total, at, np.concatenate([held[1], np.ones(len(found), np.int64)]))
            held = some, total
            if len(some) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(total)], names=[column, "total"])
                held = some[:0], total[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=[column, "total"])

    counted = rows.select("text").mapInArrow(run, f"{column} long, total long").groupBy(column).agg(F.sum("total").alias("total"))
    return counted.join(keys, column, "left_semi")


def _reached(edges: DataFrame) -> DataFrame:
    """The patterns that may ever be supported: by seeds, or by instances of patterns that may be."""
    live = written(edges.where("seed").select("i").distinct(), "live")
    size = live.count()
    while True:
        wide = written(edges.join(live, "i").groupBy("pattern").agg(F.count("*").alias("m")).where(F.col("m") >= SUPPORT).select("pattern"), "wide")
        more = written(edges.join(wide, "pattern").select("i").unionByName(live).distinct(), "live")
        dropped(live)
        live, before, size = more, size, more.count()
        if size == before:
            dropped(live)
            return wide
        dropped(wide)


def _scored(graph: DataFrame, trust: DataFrame) -> DataFrame:
    held = graph.join(trust.select("i", "conf"), "i")
    return (held.groupBy("pattern").agg((F.sum(F.col("n") * F.col("conf")) / F.greatest(F.max("total"), F.sum("n"))).alias("p"), F.sum("conf").alias("support"))
            .where(F.col("support") >= SUPPORT).select("pattern", F.least("p", F.lit(0.999)).alias("p")))


def _fillers(rows: DataFrame, strong: DataFrame) -> DataFrame:
    """``(at, start, end, parts, pattern)`` of the words in the slots of ``strong`` that touch no base span or candidate."""
    shared = rows.sparkSession.sparkContext.broadcast(key_filter(strong, "pattern"))
    schema = pa.schema([("at", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("parts", pa.list_(pa.int64())), ("pattern", pa.int64())])

    def run(batches):
        chosen = shared.value
        for batch in batches:
            out = []
            for row, w in word_hashes(batch.column(1), SPACE):
                slots = [(first + int(k), int(h[k])) for first, h in contexts(w) for k in np.flatnonzero(chosen.passes(h))]
                if not slots:
                    continue
                text, at = batch.column(1)[row].as_py(), batch.column(0)[row].as_py()
                starts = _words(text)[1]
                spans = base_spans(text)
                taken = np.zeros(len(text) + 1, bool)
                for a, b in [(a, b) for a, _, b in spans] + candidates(text, spans):
                    taken[a:b] = True
                for slot, pattern in slots:
                    a, b = WORD.match(text, int(starts[slot])).span()
                    while a < b and not text[a].isalnum():
                        a += 1
                    while a < b and not text[b - 1].isalnum():
                        b -= 1
                    parts = words_at(np.frombuffer(text[a:b].encode(), np.uint8), PUNCT)[0]
                    if len(parts) and not taken[a:b].any():
                        out.append({"at": at, "start": a, "end": b, "parts": np.unique(parts).view(np.int64).tolist(),
                                    "pattern": pattern - (1 << 64) if pattern >> 63 else pattern})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = rows.select("at", "text").mapInArrow(run, "at long, start int, end int, parts array<long>, pattern long")
    return found.join(strong, "pattern", "left_semi")


def opened(rows: DataFrame, strong: DataFrame) -> DataFrame:
    """``(at, start, end)`` of the words of any shape that stand in ``strong`` patterns and are particular to them."""
    fillers = _fillers(rows, strong).groupBy("at", "start", "end", "pattern").agg(F.count("*").alias("m"), F.first("parts").alias("parts"))
    held = written(fillers.groupBy("at", "start", "end").agg(F.max("m").alias("m"), F.first("parts").alias("parts")), "fillers")
    parts = written(held.select("m", F.explode("parts").alias("part")).groupBy("part").agg(F.sum("m").alias("inside")), "parts")
    total = _tally(rows, parts.select("part"), "part", PUNCT, lambda w: [w])
    own = parts.join(total, "part").where(F.col("inside") >= OWN * F.col("total")).select("part")
    out = written(held.select("at", "start", "end", F.explode("parts").alias("part")).join(own, "part", "left_semi").select("at", "start", "end").distinct(), "opened")
    dropped(held, parts)
    return out


def discovered(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """``(at, start, end)`` of what the scored graph trusts: candidates, and words in its surest patterns."""
    seen = written(scan.where(F.size("seen") > 0).select("at", F.explode("seen").alias("s")).select("at", "s.*"), "seen")
    edges = seen.select("i", (F.col("kind") < 4).alias("seed"), F.explode("patterns").alias("pattern"))
    edges = written(edges.groupBy("pattern", "i").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    wide = _reached(edges)
    graph = written(edges.join(_tally(rows, wide, "pattern", SPACE, lambda w: [h for _, h in contexts(w)]), "pattern"), "graph")
    dropped(edges, wide)
    trust = written(graph.groupBy("i").agg(F.max(F.col("seed").cast("double")).alias("conf")), "trust")
    while True:
        lifted = (graph.join(_scored(graph, trust), "pattern").groupBy("i")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("up")))
        conf = F.greatest("conf", F.coalesce("up", F.lit(0.0)))
        before, trust = trust, written(trust.select("i", "conf").join(lifted, "i", "left").select("i", conf.alias("conf"), (conf - F.col("conf")).alias("rise")), "trust")
        dropped(before)
        if (trust.agg(F.max("rise")).first()[0] or 0) <= SETTLED:
            break
    trusted = trust.where(F.col("conf") >= TRUST).select("i")
    found = seen.where("kind = 4").join(trusted, "i", "left_semi").select("at", "start", "end").distinct()
    strong = written(_scored(graph, trust).where(F.col("p") >= OPEN).select("pattern"), "strong")
    out = written(found if strong.isEmpty() else found.unionByName(opened(rows, strong)), "found")
    dropped(seen, graph, trust, strong)
    return out


def _with_found(scan: DataFrame, found: DataFrame) -> DataFrame:
    listed = found.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("more"))
    return scan.join(listed, "at", "left")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context)``, one row per input row.

    A null text counts as empty: no spans, the hash of the empty string. Repeated rows have equal results; null
    ids stay null. An empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    scan = written(_scan(rows), "scan")
    found = discovered(rows, scan)
    full = _with_found(scan.select("doc_id", "at", "n", "base", "sha"), found)
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("kind"), x.alias("span")))
    more = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(
        s["start"].alias("start"), F.lit(5).cast("long").alias("kind"), F.concat_ws(":", F.lit("context"), s["start"], s["end"]).alias("span")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda s: s["span"]), ",")
    count = [F.col("n")[k].alias(f"n_{KINDS[k]}") for k in range(4)]
    return full.select("doc_id", *count, F.col("sha").alias("base_sha256"),
                       F.when(F.col("more").isNull(), F.col("base")).otherwise(spans).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_context"))


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span as ``[KIND]``; spans that overlap become one, named after the first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``personal_data`` masked in the text (``n_chars``, if there, follows); null texts stay null."""
    spark = prepared(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    scan = written(_scan(rows), "scan")
    found = discovered(rows, scan)
    key, more_at, more_name = (free(n, docs.columns) for n in ("_key", "_at", "_more"))
    listed = written(found.groupBy(F.col("at").alias(more_at)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(more_name)), "listed")
    small = listed.count() <= BROADCAST_ROWS
    own = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    full = own.join(F.broadcast(listed) if small else listed, own[key] == listed[more_at], "left").drop(key, more_at)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                spans = base_spans(text) if text else []
                if more:
                    spans += [(m["start"], 4, m["end"]) for m in more]
                texts.append(masked_text(text, spans) if spans else text)
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = full.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all ``documents``."""
    return personal_data(read(spark, sf_dir, "documents"))
