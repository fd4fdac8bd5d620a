"""Base counts against plain Python, divergence against its definition, verdicts, SQL, edge rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.frames import docs

from cordon.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i: i + 3])] > 1}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAb é€𝄞#|\n\t\x0b\x0c\r\x1f\xa0.", max_size=80))
def test_base_counts(text):
    assert quality.base_counts(np.frombuffer(text.encode(), np.uint8)) == plain(text)


def test_base_counts_over_pieces(monkeypatch):
    from cordon.llm import words
    monkeypatch.setattr(words, "PIECE", 64)
    text = " ".join(f"w{k % 13} x{k % 5}" for k in range(900)) + "\n" + "long" * 100
    assert quality.base_counts(np.frombuffer(text.encode(), np.uint8)) == plain(text)


def test_divergence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
        p[2] = 0
        p /= p.sum()
        m = [(a + b) / 2 for a, b in zip(p, q)]
        want = sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2
        assert quality.divergence(p, q) == pytest.approx(math.sqrt(want))
    assert quality.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and quality.divergence(p, p) == 0


def prose(seed, n, common, rare):
    rng = random.Random(seed)
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(rare) for _ in range(5)) for _ in range(n))


EN, FI = ("the", "of", "and", "to", "in"), ("ja", "on", "ei", "se", "oli")


def corpus():
    rows = [(k, prose(k, 300, EN, "abcdefgh"), "s", "en") for k in range(40)]
    return rows + [(100 + k, prose(k, 300, FI, "ijklmäö"), "s", "fi") for k in range(40)]


def judge(spark, rows):
    return {r.doc_id: r for r in quality.judged(docs(spark, rows)).collect()}


def test_verdicts(spark):
    rows = corpus() + [
        (500, prose(7, 300, EN, "$%&#*"), "s", "en"),  # symbols for letters
        (501, " ".join(f"zq{k}" for k in range(400)), "s", "en"),  # no common words
        (502, prose(8, 300, FI, "ijklmäö"), "s", "en"),  # label wrong, text fine
        (503, prose(9, 300, EN, "abcdefgh"), "s", None), (504, prose(9, 300, EN, "abcdefgh"), "s", "xx"),
        (505, prose(10, 49, EN, "abcdefgh"), "s", "en"),  # too short
        (506, "the of and " * 60, "s", "en"),  # repeats
        (507, prose(11, 60, EN, "abcdefgh"), "s", "en"),  # short, but long enough
    ]
    got = judge(spark, rows)
    assert all(r.kept for k, r in got.items() if k < 200)
    assert {k for k, r in got.items() if not r.kept} == {500, 501, 505, 506}
    assert {k for k, r in got.items() if r.base_failed} == {505, 506}
    assert got[500].char_distance > 0.3 and got[501].word_distance > 0.5
    assert got[503].char_distance is not None and got[505].word_distance is None


def test_edges(spark):
    empty = quality.judged(docs(spark, []))
    assert empty.count() == 0
    got = quality.judged(docs(spark, [(1, None, "s", None), (2, "", "s", "en"), (None, " \n ", None, "en"), (3, "one", "s", "en"), (3, "one", "s", "en")])).collect()
    assert len(got) == 5 and all(r.base_failed and not r.kept and r.word_distance is None for r in got)
    assert [r.n_words for r in got if r.doc_id == 3] == [1, 1]
    few = judge(spark, [(1, prose(1, 100, EN, "abc"), "s", "en")])  # no language has a reference
    assert few[1].kept and few[1].char_distance is None


def test_clashing_columns_and_long_texts(spark):
    rows = corpus() + [(900, prose(3, 300_000, EN, "abcdefgh"), "s", "en")]
    extra = docs(spark, rows).selectExpr("*", "1 AS kept", "2 AS _text", "3 AS _lang", "4 AS n_words", "5 AS n", "6 AS kind")
    got = {r.doc_id: r for r in quality.judged(extra).collect()}
    assert len(got) == len(rows) and got[900].kept and got[900].n_words == 300_000
    assert tuple(got[900])[1:6] == plain(rows[-1][1])


def test_references_take_all_rows_and_bound_labels(spark):
    rows = corpus() + [(1000 + k, prose(k, 20, EN, "abc"), "s", f"dirty{k}") for k in range(300)]
    refs = quality.references(docs(spark, rows).repartition(9))
    assert refs.names == ["en", "fi"]
    words = Counter(w for r in rows if r[3] == "en" for w in r[1].split())
    total = sum(words.values())
    common = [n / total for n in words.values() if n >= quality.COMMON * total]
    assert sorted(refs.shares[0][:-1]) == pytest.approx(sorted(common)) and refs.shares[0][-1] == pytest.approx(1 - sum(common))


def test_query_equals_sql(spark):
    got = sorted(map(tuple, quality.op13_quality_divergence(spark, SF001).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    assert got == sorted(con.execute(quality.ORACLE_SQL).fetchall())
    assert 0 < sum(r[7] for r in got) < len(got)
