"""Licence notices and inheritance: cosine against a plain one, nearest directory, edge rows, given documents."""

import math

import pytest
from conftest import SF01
from llm.frames import prose

from cordon.llm import licenses as s
from cordon.llm.tables import read

TREE = [("a/LICENSE", "Released under the MIT License."), ("a/x.txt", prose(1, 50)), ("a/b/y.txt", prose(2, 50)),
        ("a/b/c/COPYING.md", "intro\nLicensed under the Apache License, Version 2.0.\nend"), ("a/b/c/d/e.txt", prose(3, 9)),
        ("a/own.txt", prose(4, 400) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + prose(5, 400)),
        ("ab/z.txt", prose(6, 20)), ("top.txt", prose(7, 20)), (None, "Licensed under CC BY-NC 4.0."), ("n.txt", None), ("e.txt", ""),
        ("a/x.txt", prose(1, 50)), ("q/about.txt", "the license of a bird is its song under the open sky"), ("r/LICENSE", prose(8, 30))]


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_inheritance(spark):
    got = s.scan(files(spark, TREE).selectExpr("*", "1 AS license", "2 AS d", "3 AS dir")).collect()
    assert len(got) == len(TREE)
    by = {r.path: (r.license, r.effective, r.from_dir) for r in got}
    assert by["a/x.txt"] == (None, "MIT", "a") and by["a/b/y.txt"] == (None, "MIT", "a")
    assert by["a/b/c/d/e.txt"] == (None, "Apache-2.0", "a/b/c")
    assert by["a/own.txt"] == ("GPL-3.0", "GPL-3.0", None)
    assert by["ab/z.txt"] == by["top.txt"] == by["q/about.txt"] == by["r/LICENSE"] == by["e.txt"] == (None, None, None)
    assert by[None] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)


def test_root_license_and_ties(spark):
    rows = [("LICENSE", "Licensed under the MIT License."), ("LICENSE.old", "Licensed under CC BY 4.0."), ("x/y/z.txt", "a")]
    got = {r.path: (r.effective, r.from_dir) for r in s.scan(files(spark, rows)).collect()}
    assert got["x/y/z.txt"] == ("CC-BY-4.0", "")
    assert s.scan(files(spark, [])).count() == 0


def test_cosine_equals_a_plain_one(spark):
    texts = [t or "" for _, t in TREE]
    df, n = s.frequencies(files(spark, TREE), s.TEMPLATES)
    assert n == len(TREE)
    t = s.Templates(s.TEMPLATES, df, n)
    words = lambda x: "".join(c.lower() if c.isalnum() else " " for c in x).split()
    vocabulary = {w for _, x in s.TEMPLATES for w in words(x)}
    idf = {w: math.log((n + 1) / (sum(w in words(x) for x in texts) + 1)) + 1 for w in vocabulary}

    def vector(ws):
        return {w: (1 + math.log(ws.count(w))) * idf[w] for w in ws if w in vocabulary}

    line = "Licensed under the Apache License, Version 2.0 (the License), x y."
    a = vector(words(line))
    norm = math.sqrt(sum(v * v for v in a.values()) + 2 * t.unknown ** 2)
    want = max((round(sum(a.get(w, 0) * v for w, v in b.items()) / norm / math.sqrt(sum(v * v for v in b.values())), 9), -k)
               for k, b in enumerate(vector(words(x)) for _, x in s.TEMPLATES))
    import pyarrow as pa

    from cordon.llm.words import PUNCT, word_hashes
    got = t.best(next(word_hashes(pa.array([line]), PUNCT))[1])
    assert got[0] == pytest.approx(want[0], abs=1e-8) and got[1] == -want[1]


def test_given_documents(spark):
    """Every customary notice of the given documents is found, and nothing else."""
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    d = read(spark, SF01, "documents")
    got = {r.doc_id: r.license for r in s.notices(s.tree(d), key=("doc_id", "path")).collect()}
    for r in d.collect():
        want = {v for k, v in notices.items() if k in (r.text or "").split("\n")}
        assert (got[r.doc_id] in want) if want else got[r.doc_id] is None, r.doc_id


def test_long_lines(spark, monkeypatch):
    rows = [("a", prose(1, 60_000) + "\nLicensed under CC BY-NC 4.0.\n" + prose(2, 60_000) + "\n"), ("b", prose(3, 200_000))]
    got = {r.path: r.license for r in s.scan(files(spark, rows)).collect()}
    assert got == {"a": "CC-BY-NC-4.0", "b": None}


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
ASF = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"), to deal"""


def test_wrapped_headers_full_files_and_one_line_documents(spark):
    """Notices over line breaks, inside longer lines and in lines of any length; versions by the words that follow."""
    want = {"gpl3": ("GPL-3.0", GPL3), "gpl2": ("GPL-2.0", GPL3.replace("software:", "software;").replace("version 3", "version 2")),
            "agpl": ("AGPL-3.0", GPL3.replace("GNU General", "GNU Affero General")),
            "lgpl": ("LGPL-2.1", GPL3.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")),
            "asf": ("Apache-2.0", ASF), "bsd": ("BSD-3-Clause", BSD), "mit": ("MIT", MIT),
            "title": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3"), "full": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + prose(11, 3000)),
            "full_mit": ("MIT", "MIT License\n\nCopyright (c) 2020 A\n\n" + MIT + "\n" + prose(12, 300)),
            "inside": ("MIT", prose(13, 11) + " Released under the MIT License. " + prose(14, 11)),
            "one_line": ("Apache-2.0", prose(15, 5000) + " Licensed under the Apache License, Version 2.0. " + prose(16, 5000)),
            "released": ("Apache-2.0", "Licensed under the Apache License"), "none": (None, prose(17, 900) + " the license of this version " + prose(18, 900))}
    want |= {f"{k}_in_text": (v, prose(20, 500) + "\n" + t + "\n" + prose(21, 500)) for k, (v, t) in want.items() if k in ("gpl3", "gpl2", "asf", "bsd", "mit")}
    rows = [(k, t) for k, (_, t) in want.items()] + [(f"p{i}", prose(100 + i, 60)) for i in range(60)]
    got = {r.path: r.license for r in s.notices(files(spark, rows)).collect()}
    assert {k: got[k] for k in want} == {k: v for k, (v, _) in want.items()}
    assert not any(got[f"p{i}"] for i in range(60))


COPYRIGHT = "Copyright (c) 2021, A. N. Author\nAll rights reserved.\n\n"
BSD2 = COPYRIGHT + s._BSD[0] + ":\n\n1. " + s._BSD[1].replace("Redistributions in", "\n2. Redistributions in") + "\n\n" + s._BSD[3]
BSD3 = COPYRIGHT + s._BSD[0] + ":\n\n1. " + s._BSD[1].replace("Redistributions in", "\n2. Redistributions in") + "\n\n3. " + s._BSD[2] + "\n\n" + s._BSD[3]


def test_full_licence_texts(spark):
    """Licences that share sentences are told apart by their full texts; versions by their own words."""
    want = {"bsd2": ("BSD-2-Clause", BSD2), "bsd3": ("BSD-3-Clause", BSD3), "isc": ("ISC", "ISC License\n\n" + COPYRIGHT + s._ISC[0] + "\n\n" + s._ISC[1]),
            "mit": ("MIT", "MIT License\n\n" + COPYRIGHT + s._MIT[1] + "\n\n" + s._MIT[2]), "zlib": ("Zlib", COPYRIGHT + s._ZLIB), "unlicense": ("Unlicense", s._UNLICENSE),
            "epl2": ("EPL-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at"),
            "lgpl21": ("LGPL-2.1", s._gnu("library", "Lesser ", "2.1")[1]), "gpl2": ("GPL-2.0", s._gnu("program", "", "2")[1]), "agpl": ("AGPL-3.0", s._gnu("program", "Affero ", "3", True)[1])}
    want |= {f"{k}_in_text": (v, prose(30, 700) + "\n" + t.replace(" ", "\n * ") + "\n" + prose(31, 700)) for k, (v, t) in want.items() if k in ("bsd2", "bsd3", "lgpl21")}
    rows = [(k, t) for k, (_, t) in want.items()] + [(f"p{i}", prose(200 + i, 60) + " the of and to in is for this with or") for i in range(60)]
    got = {r.path: r.license for r in s.notices(files(spark, rows)).collect()}
    assert {k: got[k] for k in want} == {k: v for k, (v, _) in want.items()}
    assert not any(got[f"p{i}"] for i in range(60))


def _templates(texts):
    import pyarrow as pa

    from cordon.llm.words import PUNCT, word_hashes
    words = [w for _, w in word_hashes(pa.array(texts, pa.string()), PUNCT)]
    vocabulary = {int(x) for _, w in word_hashes(pa.array([t for _, t in s.TEMPLATES], pa.string()), PUNCT) for x in w.view("int64")}
    df = {v: sum(v in set(map(int, w.view("int64"))) for w in words) for v in vocabulary}
    return s.Templates(s.TEMPLATES, df, len(texts)), words


def min_sum(a, b):
    return sum(min(int(x), int(y)) for x, y in zip(a, b, strict=True))


def test_chosen_licence_equals_a_search_of_all_runs():
    """Every run of up to a template's length is scored against it; the one with most matched words decides."""
    notices = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 2.",
               "released under the license of MIT", "Licensed under the Apache License, Version 2.0 (the License); you may not use this", "Mozilla Public License, version 1.1", s._ISC[0]]
    texts = [prose(40 + k, 8) + " " + n + " " + prose(60 + k, 8) for k, n in enumerate(notices)] + [notices[0] + " " + notices[3]] + [prose(90 + k, 30) for k in range(60)]
    t, words = _templates(texts)
    for w, text in zip(words, texts, strict=True):
        best = None
        for k, size in enumerate(t.lengths):
            for a in range(len(w)):
                for b in range(a + 2, min(len(w), a + size) + 1):
                    found = t.cosines(w[a:b])
                    if found is None or (t.marked[k] and not (t.own[k] & (found[1] > 0)).any()):
                        continue
                    score = round(float(found[0][k]), 9)
                    matched = score * min_sum(found[1], t.counts[k])
                    if score >= s.NOTICE and (best is None or (round(matched, 6), score) > best[0]):
                        best = (round(matched, 6), score), t.names[k]
        got = t.notice(w)
        assert (got and got[1]) == (best and best[1]), text


def test_notice_dense_texts_are_quick():
    """Repeated notices are scored once; a text of nothing but templates stays within seconds and a few megabytes."""
    import time
    import tracemalloc
    lines = ["Licensed under the Apache License, Version 2.0.\n" * 4000, "\n".join(x for _, x in s.TEMPLATES) * 300, "is the of license " * 100_000]
    t, words = _templates(lines + [prose(k, 50) for k in range(50)])
    for w, limit, name in zip(words, (0.5, 20, 5), ("Apache-2.0", "BSD-3-Clause", None), strict=False):
        start = time.time()
        found = t.notice(w)
        assert time.time() - start < limit and (name is None or found[1] == name)
    tracemalloc.start()
    t.notice(words[1])
    assert tracemalloc.get_traced_memory()[1] < 200e6


def test_notice_at_the_border_of_parts(monkeypatch):
    monkeypatch.setattr(s, "PART", 64)
    t, words = _templates([prose(k, 20 + k) + " Licensed under the Apache License, Version 2.0. " + prose(3, 300) for k in range(90)])
    assert all(t.notice(w) == (1.0, "Apache-2.0") for w in words)
