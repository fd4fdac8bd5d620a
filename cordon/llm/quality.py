"""Quality rules: base counts of every text, and the divergence of its histograms from references of its language.

1. References: one pass adds up, for every language, character classes and word counts over all documents
   (combined inside tasks, then by shuffle); the words that make ``COMMON`` of a language's words at least, and the share
   of all others, are its word reference. A language with under ``LEAST_WORDS`` words, or under ``LEAST_SHARE`` of all, has
   none. So there are at most ``1 / LEAST_SHARE`` references of ``1 / COMMON`` words, whatever labels a dirty column holds.
2. Verdict: one more pass gives each text's own histograms and their Jensen-Shannon distance (root of the divergence in
   bits, 0 to 1) to its language's reference. A text that diverges from it, or has none, is held against the other references
   and kept if it is near one in both: labels may be wrong.
   Short texts scatter widely around any reference, so a test only applies from a minimum length on
   (``LEAST_CHARS`` characters in words, ``LEAST_TEXT`` words), and a limit widens with the number of
   things counted: ``limit + SLACK / sqrt(count)``.

Words are cut and counted by array operations over Arrow batches, long texts in pieces; per text only its own words
are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import prepared, read
from .words import SPACE, _cut, _powers, mix, pieces, texts, word_hashes

#: Base rules: fewest words, and the greatest percentage of words in repeated windows of WINDOW words.
LEAST_BASE, REPEATED, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
#: Share of a language's words that makes a word common; words and share of all words that it takes to be a reference.
COMMON, LEAST_WORDS, LEAST_SHARE = 0.001, 2000, 0.001
#: Lengths from which the tests apply.
LEAST_CHARS, LEAST_TEXT = 200, 50
#: Greatest distances of a kept text, beyond what its length explains.
CHAR_LIMIT, WORD_LIMIT, SLACK = 0.25, 0.35, 1.5
#: Character classes by byte: lower case, upper case, digits, full stop and comma, other ASCII punctuation, symbols of the
#: base rule, beyond ASCII (lead bytes), others. White space and continuation bytes are of no class.
CLASSES = 8

_U = np.uint64
_CLASS = np.full(256, 7, np.int8)
_CLASS[0x21:0x7F] = 4
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[ord("."), ord(",")]] = 3
_CLASS[list(SYMBOLS)] = 5
_CLASS[0xC0:] = 6
_CLASS[list(SPACE)] = -1
_CLASS[0x80:0xC0] = -1


def character_classes(data: np.ndarray) -> np.ndarray:
    """How many characters of each class UTF-8 bytes hold."""
    return np.bincount(_CLASS[data].astype(np.int64) + 1, minlength=CLASSES + 1)[1:]


def exact_words(data: np.ndarray) -> np.ndarray:
    """Fingerprint (letter case kept) of every word of one text, piece by piece."""
    values = [np.zeros(0, _U)]
    for a, b in pieces(data, SPACE):
        own = data[a:b]
        starts, ends = _cut(own, np.zeros(1, np.int64), SPACE)
        power, inverse = _powers(len(own) + 1)
        total = np.zeros(len(own) + 1, _U)
        np.cumsum((own.astype(_U) + _U(1)) * power[: len(own)], out=total[1:])
        values.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U)))
    return np.concatenate(values)


def repeated_words(words: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    key = np.zeros(n, _U)
    for j in range(size):
        key = mix(key + words[j: n + j])
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    again = (count[which] > 1).astype(np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += again
    cover[size: n + size] -= again
    return int((np.cumsum(cover)[:-1] > 0).sum())


def repeated_lines(data: np.ndarray) -> int:
    """Lines with a word that equal an earlier line."""
    if not (data == 10).any():
        return 0
    seen: set[bytes] = set()
    again = 0
    for line in data.tobytes().split(b"\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return again


def base_counts(data: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text's UTF-8 bytes."""
    words = exact_words(data)
    kinds = np.bincount(data, minlength=256)
    chars = int(kinds[:0x80].sum() + kinds[0xC0:].sum() - kinds[list(SPACE)].sum())
    return len(words), chars, int(kinds[list(SYMBOLS)].sum()), repeated_lines(data), repeated_words(words)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a distribution to each row of others, in bits; 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        two = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.clip((one + two) / 2, 0, 1))


class References:
    """Character-class and common-word distributions per language (names sorted; null is a language)."""

    def __init__(self, names: list[str | None], chars: np.ndarray, words: list[np.ndarray], shares: list[np.ndarray]):
        self.names = names
        self.at = {name: k for k, name in enumerate(names)}
        self.chars = chars  # languages x classes
        self.words = words  # sorted fingerprints of the common words
        self.shares = shares  # their shares, then that of all other words

    def distances(self, k: int, chars: np.ndarray, words: np.ndarray) -> tuple[float | None, float | None]:
        """Distances of character classes and common words to reference ``k``; None where the text is too short for the test."""
        by_char = by_word = None
        total = int(chars.sum())
        if total >= LEAST_CHARS:
            by_char = float(divergence(chars / total, self.chars[k]))
        if len(words) >= LEAST_TEXT:
            v = self.words[k]
            if len(v):
                at = np.searchsorted(v, words)
                at[at == len(v)] = 0
                at = at[v[at] == words]
            else:
                at = np.zeros(0, np.int64)
            counts = np.append(np.bincount(at, minlength=len(v)), len(words) - len(at))
            by_word = float(divergence(counts / len(words), self.shares[k]))
        return by_char, by_word

    def verdict(self, lang: str | None, chars: np.ndarray, words: np.ndarray) -> tuple[bool, float | None, float | None]:
        """Whether the text is near its language's reference, or else another, and its distances to its language's
        (without one, to the reference with the least sum of both; ties: the first name)."""
        if not self.names:
            return True, None, None
        char_limit, word_limit = CHAR_LIMIT + SLACK / np.sqrt(max(chars.sum(), 1)), WORD_LIMIT + SLACK / np.sqrt(max(len(words), 1))
        near = lambda d: (d[0] is None or d[0] <= char_limit) and (d[1] is None or d[1] <= word_limit)
        if lang in self.at:
            own = self.distances(self.at[lang], chars, words)
            if near(own):
                return True, *own
            return any(near(self.distances(k, chars, words)) for k in range(len(self.names)) if k != self.at[lang]), *own
        every = [self.distances(k, chars, words) for k in range(len(self.names))]
        return any(map(near, every)), *min(every, key=lambda d: (d[0] or 0) + (d[1] or 0))


def _histograms(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``(lang, kind, item, n)``: counts of character classes (kind 0) and words (1) and of all words (2) per language."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        size = 0

        def emit():
            for lang, (chars, words) in held.items():
                v, n = np.unique(np.concatenate(words), return_counts=True) if words else (np.zeros(0, _U), np.zeros(0, np.int64))
                kind = np.repeat(np.array([0, 1, 2], np.int8), [CLASSES, len(v), 1])
                item = np.concatenate([np.arange(CLASSES), v.view(np.int64), [0]])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kind), pa.string()), pa.array(kind), pa.array(item, pa.int64()), pa.array(np.concatenate([chars, n, [n.sum()]]), pa.int64())],
                                                 names=["lang", "kind", "item", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = texts(batch.column(1))
            for row, words in word_hashes(batch.column(1), SPACE):
                own = held.setdefault(langs[row], [np.zeros(CLASSES, np.int64), []])
                own[0] += character_classes(data[offsets[row]: offsets[row + 1]])
                own[1].append(words.copy())
                size += len(words) + 16
                if size > 4_000_000:  # 32 MB of fingerprints
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    prepared(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, kind byte, item long, n long")
    return rows.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> References:
    """References of the languages of ``docs``, from all its texts."""
    counts = _histograms(docs, lang_col, text_col)
    total = counts.where("kind = 2").withColumn("all", F.sum("n").over(W.partitionBy()))  # one row a language
    large = total.where((F.col("n") >= LEAST_WORDS) & (F.col("n") >= LEAST_SHARE * F.col("all"))).select(F.col("lang").alias("_lang"), F.col("n").alias("words"))
    kept = counts.where("kind < 2").join(F.broadcast(large), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")  # at most 1 / LEAST_SHARE rows
    rows = kept.where((F.col("kind") == 0) | (F.col("n") >= COMMON * F.col("words"))).select("lang", "kind", "item", "n", "words").collect()
    names = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, x))
    chars, words, shares = np.zeros((len(names), CLASSES)), [], []
    for k, name in enumerate(names):
        own = [r for r in rows if r["lang"] == name]
        for r in own:
            if r["kind"] == 0:
                chars[k, r["item"]] = r["n"]
        chars[k] /= max(chars[k].sum(), 1)
        common = sorted((int(np.int64(r["item"]).view(_U)), r["n"]) for r in own if r["kind"] == 1)
        words.append(np.array([v for v, _ in common], _U))
        share = np.array([n for _, n in common], float) / own[0]["words"]
        shares.append(np.append(share, max(0.0, 1 - share.sum())))
    return References(names, chars, words, shares)


def judged(docs: DataFrame, refs: References | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, and the two distances.

    A null text counts as empty: no words, so the base rules fail it. A null or unknown language is held against all
    references; where no language has one (few texts), the base rules alone decide. A distance is null where the text is too
    short for its test. Equal rows are judged alike, each by itself. Other columns are ignored, whatever their names.
    """
    refs = references(docs, lang_col, text_col) if refs is None else refs
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(refs)  # at most 1 / LEAST_SHARE languages
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        r = shared.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = texts(batch.column(2))
            out = []
            for row, words in word_hashes(batch.column(2), SPACE):
                own = data[offsets[row]: offsets[row + 1]]
                counts = base_counts(own)
                failed = counts[0] < LEAST_BASE or 100 * counts[4] > REPEATED * counts[0]
                chars = character_classes(own)
                near, by_char, by_word = r.verdict(langs[row], chars, words)
                out.append((*counts, failed, near and not failed, by_char, by_word))
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                             names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                "base_failed boolean, kept boolean, char_distance double, word_distance double")


def op13_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all ``documents``."""
    out = judged(read(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [len(regexp_replace(t, '[^a-z]', '', 'g')), len(regexp_replace(t, '[^A-Z]', '', 'g')), len(regexp_replace(t, '[^0-9]', '', 'g')), len(regexp_replace(t, '[^.,]', '', 'g')),
     len(regexp_replace(t, '[^!"''()+\-/:;=?@\[\\\]^_`{}~]', '', 'g')), len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), len(regexp_replace(t, '[\x00-\x7F]', '', 'g')),
     len(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F]', '', 'g'))] AS classes
  FROM documents),
words AS (SELECT r, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE c IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, sum(n - 1)::BIGINT AS n FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
base AS (SELECT d.r, doc_id, lang, classes, list_sum(classes)::DOUBLE AS chars, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars, classes[6]::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines l ON l.r = d.r LEFT JOIN repeats p ON p.r = d.r),
low AS (SELECT r, lang, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM words),
own AS (SELECT r, word, count(*) AS n FROM low GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS n FROM low GROUP BY lang),
langs AS (SELECT lang, n, row_number() OVER (ORDER BY lang NULLS FIRST) AS k FROM sizes WHERE n >= 2000 AND n >= 0.001::DOUBLE * (SELECT sum(n) FROM sizes)),
common AS (SELECT langs.k, word, count(*)::DOUBLE / any_value(langs.n) AS q FROM low JOIN langs ON low.lang IS NOT DISTINCT FROM langs.lang GROUP BY ALL HAVING count(*) >= 0.001::DOUBLE * any_value(langs.n)),
rest AS (SELECT langs.k, greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(sum(q), 0)) AS q FROM langs LEFT JOIN common ON common.k = langs.k GROUP BY langs.k),
class AS (SELECT k, c, sum(classes[c])::DOUBLE / greatest(sum(chars), 1) AS q FROM base JOIN langs ON base.lang IS NOT DISTINCT FROM langs.lang, range(1, 9) AS x(c) GROUP BY k, c),
by_class AS (SELECT r, k, sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS js
  FROM (SELECT r, k, classes[c] / chars AS p, q FROM base, class WHERE chars >= 200) GROUP BY r, k),
pairs AS (SELECT b.r, c.k, c.q, coalesce(own.n, 0) / b.n_words::DOUBLE AS p FROM base b CROSS JOIN common c LEFT JOIN own ON own.r = b.r AND own.word = c.word WHERE b.n_words >= 50),
all_pairs AS (SELECT r, k, p, q FROM pairs UNION ALL
  SELECT b.r, rest.k, (b.n_words - coalesce(s.n, 0)) / b.n_words::DOUBLE, rest.q FROM base b CROSS JOIN rest
    LEFT JOIN (SELECT own.r, c.k, sum(own.n) AS n FROM own JOIN common c ON c.word = own.word GROUP BY ALL) s ON s.r = b.r AND s.k = rest.k WHERE b.n_words >= 50),
by_word AS (SELECT r, k, sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS js FROM all_pairs GROUP BY r, k),
held AS (SELECT b.r, l.k, c.js AS jc, w.js AS jw, l.lang IS NOT DISTINCT FROM b.lang AS mine, coalesce(c.js <= 0.25 + 1.5 / sqrt(greatest(chars, 1)), true) AND coalesce(w.js <= 0.35 + 1.5 / sqrt(greatest(n_words, 1)), true) AS near
  FROM base b CROSS JOIN langs l LEFT JOIN by_class c ON c.r = b.r AND c.k = l.k LEFT JOIN by_word w ON w.r = b.r AND w.k = l.k),
verdict AS (SELECT r, bool_or(near) AS near, arg_min({'c': jc, 'w': jw}, (NOT mine)::INT * 10 + (CASE WHEN mine THEN 0 ELSE coalesce(jc, 0) + coalesce(jw, 0) END)) AS j FROM held GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(near, true) AS kept, round(j.c, 6) AS char_distance, round(j.w, 6) AS word_distance
FROM base LEFT JOIN verdict v ON v.r = base.r
"""
