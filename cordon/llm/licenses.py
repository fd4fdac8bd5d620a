"""License scans: TF-IDF cosine of passages to licence templates, then inheritance from the nearest directory.

1. Runs of words of every file (headers, licence files, notices anywhere) are compared with the templates, full licence
   texts, customary headers, one-line notices and titles, as sparse TF-IDF vectors over the templates' vocabulary. Document
   frequencies of that vocabulary are counted over all files. A run starts at a word of the template, is at most as long
   as the template and ends at its last word there; line breaks don't matter. Of runs that reach ``NOTICE`` the one that matches
   most of a template's words (their number times the cosine) names the licence, so a full text decides over a sentence
   that it shares with another licence, and versions differ by the weights of their own words.
2. A licence file's licence holds for its directory. A file without a notice of its own takes that of
   its nearest ancestor directory that has one: distinct directories explode into their ancestors (a few rows
   each), join the licensed directories by path, and keep the deepest; files then join their directory.

A text's runs are found by array operations over parts of ``PART`` words; a run's score depends on its words alone,
so repeated notices are scored once, and runs are scored in the order of an upper bound until no other can be better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .tables import prepared, read, written
from .words import PUNCT, mix, word_hashes

_WARRANTY = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.")


def _gnu(work: str, family: str, version: str, newer: bool = False) -> tuple[str, str]:
    """The two customary header paragraphs of a GNU licence."""
    colon, comma = (":", ",") if newer else (";", ";")
    first = (f"This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {family}General Public License as published by "
             f"the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
    return first, f"{first} {_WARRANTY.format(work, family)}"


_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software.""",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""")
_ISC = ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
           """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means."""

#: Texts by which licences state themselves (fixed values: their customary wording). Longer licences by title and header.
TEMPLATES = (
    ("MIT", _MIT[0]), ("MIT", _MIT[1]), ("MIT", f"{_MIT[1]} {_MIT[2]}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE[0]), ("Apache-2.0", _APACHE[1]),
    ("Apache-2.0", "Apache License Version 2.0"),
    *[("GPL-1.0", t) for t in _gnu("program", "", "1")],
    *[("GPL-2.0", t) for t in _gnu("program", "", "2")],
    *[("GPL-3.0", t) for t in _gnu("program", "", "3", True)],
    *[("LGPL-2.0", t) for t in _gnu("library", "Library ", "2")],
    *[("LGPL-2.1", t) for w in ("library", "program") for t in _gnu(w, "Lesser ", "2.1")],
    *[("LGPL-3.0", t) for w in ("library", "program") for t in _gnu(w, "Lesser ", "3", True)],
    *[("AGPL-3.0", t) for t in _gnu("program", "Affero ", "3", True)],
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("BSD-3-Clause", _BSD[0]),
    ("BSD-2-Clause", f"{_BSD[0]} {_BSD[1]}"), ("BSD-2-Clause", f"{_BSD[0]} {_BSD[1]} {_BSD[3]}"),
    ("BSD-3-Clause", f"{_BSD[0]} {_BSD[1]} {_BSD[2]}"), ("BSD-3-Clause", f"{_BSD[0]} {_BSD[1]} {_BSD[2]} {_BSD[3]}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", _ISC[0]), ("ISC", f"{_ISC[0]} {_ISC[1]}"), ("ISC", "Released under the ISC License."),
    ("Zlib", _ZLIB),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Unlicense", _UNLICENSE),
)
#: A run of words has a licence if its cosine with a template is at least this.
NOTICE = 0.75
#: Words of a text that are searched at once.
PART = 1 << 17
#: Names of files whose licence holds for their directory.
LICENSE_FILE = r"(?i)^(license|licence|copying|unlicense|notice)([._-].*)?$"


class Templates:
    """Sparse TF-IDF vectors of the templates over their own vocabulary."""

    def __init__(self, templates: tuple[tuple[str, str], ...], df: dict[int, int], n_files: int):
        self.names = [name for name, _ in templates]
        sets = [w for _, w in word_hashes(pa.array([t for _, t in templates], pa.string()), PUNCT)]
        self.vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        # A word in few files weighs much; words of no file weigh most.
        counts = np.array([df.get(int(v), 0) for v in self.vocabulary.view(np.int64)], np.float64)
        self.idf = np.log((n_files + 1) / (counts + 1)) + 1
        rows = np.zeros((len(sets), len(self.vocabulary)))
        for k, w in enumerate(sets):
            np.add.at(rows[k], np.searchsorted(self.vocabulary, w), 1)
        self.counts = rows.astype(np.int64)
        rows = (1 + np.log(np.maximum(rows, 1))) * (rows > 0) * self.idf
        self.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        self.unknown = float(np.log(n_files + 1) + 1) / 2  # a word outside the vocabulary; its document frequency isn't counted

        self.lengths = [len(w) for w in sets]
        self.part = self.rows ** 2  # of each word in a template's norm
        holds = self.rows > 0
        others = np.array([[a != b for b in self.names] for a in self.names])
        # Words of no other licence's template; a run needs one of them where a template has any.
        self.own = holds & ~((others.astype(np.int64) @ holds) > 0)
        self.marked = self.own.any(axis=1)

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vocabulary's words in ``words``, and which words they are."""
        if not len(self.vocabulary) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        hit = np.flatnonzero(self.vocabulary[at] == words)
        return hit, at[hit]

    def cosines(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Cosine of one run with each template, and how often it holds each word of the vocabulary."""
        if len(words) < 2:
            return None
        hit, at = self.known(words)
        if len(hit) < 2:
            return None
        tf = np.bincount(at, minlength=len(self.vocabulary))
        v = (1 + np.log(np.maximum(tf, 1))) * (tf > 0) * self.idf
        rest = np.ones(len(words), bool)
        rest[hit] = False
        others = len(np.unique(words[rest]))
        return self.rows @ v / np.sqrt(v @ v + others * self.unknown ** 2), tf

    def best(self, words: np.ndarray) -> tuple[float, int] | None:
        """Cosine and number of the nearest template of one run (ties: the earlier one)."""
        found = self.cosines(words)
        if found is None:
            return None
        k = int(found[0].argmax())
        return round(float(found[0][k]), 9), k

    def runs(self, words: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(bound, template, first word, end) of runs that can reach ``NOTICE``; each different set of words once.

        The bound on cosine times matched words: the root of the part of the template's norm that the run's words make up, times their number. Of
        runs of a template that begin within a quarter of its length of each other the one with the greatest bound counts.
        """
        hit, at = self.known(words)
        if len(hit) < 2:
            return []
        least = NOTICE ** 2 - 1e-6
        present = np.bincount(at, minlength=len(self.vocabulary)) > 0
        sums = np.append(np.uint64(0), np.cumsum(mix(words)))
        out = []
        for k in np.flatnonzero((self.part @ present >= least) & (~self.marked | (self.own @ present))):
            part = self.part[k][at]
            mine = np.flatnonzero(part > 0)
            place, part = hit[mine], part[mine]
            total = np.append(0.0, np.cumsum(part))
            end = np.searchsorted(place, place + self.lengths[k])
            sure = total[end] - total[:-1]
            able = np.flatnonzero(sure >= least)
            if self.marked[k]:
                own = np.append(0, np.cumsum(self.own[k][at[mine]]))
                able = able[own[end[able]] > own[able]]
            if not len(able):
                continue
            group = place[able] // max(1, self.lengths[k] // 4)
            order = np.lexsort((able, -sure[able], group))
            able = able[order[np.append(True, np.diff(group[order]) > 0)]]
            first, last = place[able], place[end[able] - 1] + 1
            _, once = np.unique(sums[last] - sums[first] + (last - first).astype(np.uint64), return_index=True)
            able = able[once]
            bound = np.minimum(1.0, np.sqrt(sure[able])) * np.minimum(self.lengths[k], end[able] - able)
            out += [(float(b), int(k), int(f), int(e)) for b, f, e in zip(bound, first[once], last[once], strict=True)]
        return sorted(out, key=lambda r: (-r[0], r[2], r[1]))

    def notice(self, words: np.ndarray) -> tuple[float, str] | None:
        """Cosine and licence of the run with the most matched words of a template, weighted by its cosine (ties: the higher cosine, the first run)."""
        top: tuple[float, float, int] | None = None
        reach = max(self.lengths, default=1)
        for start in range(0, max(1, len(words) - reach), PART):
            own = words[start: start + PART + reach]
            for bound, k, first, end in self.runs(own):
                if top is not None and bound < top[0] - 1e-9:
                    break
                found = self.cosines(own[first:end])
                if found is None or (self.marked[k] and not (self.own[k] & (found[1] > 0)).any()):
                    continue
                score = round(float(found[0][k]), 9)
                if score < NOTICE:
                    continue
                matched = score * int(np.minimum(found[1], self.counts[k]).sum())
                if top is None or matched > top[0] + 1e-9 or (matched > top[0] - 1e-9 and score > top[1]):
                    top = matched, score, k
        return top and (top[1], self.names[top[2]])


def frequencies(files: DataFrame, templates, text_col: str = "text") -> tuple[dict[int, int], int]:
    """In how many files each template word occurs, over all files; and the number of files."""
    spark = prepared(files.sparkSession)
    vocabulary = np.unique(np.concatenate([w for _, w in word_hashes(pa.array([t for _, t in templates], pa.string()), PUNCT)]))
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        total, n = np.zeros(len(v), np.int64), 0
        for batch in batches:
            for _, words in word_hashes(batch.column(0), PUNCT):
                at = np.searchsorted(v, words)
                at[at == len(v)] = 0
                total[np.unique(at[v[at] == words])] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(v.view(np.int64), 0)), pa.array(np.append(total, n)), pa.array(np.append(np.zeros(len(v), bool), True))], names=["word", "n", "all"])

    rows = files.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long, all boolean").groupBy("word", "all").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: int(r["n"]) for r in rows if not r["all"]}, sum(int(r["n"]) for r in rows if r["all"])


def notices(files: DataFrame, templates=TEMPLATES, key: tuple[str, ...] = ("path",), text_col: str = "text") -> DataFrame:
    """The key columns with ``license`` and ``score`` of each file's best run of words (null and 0 without one)."""
    spark = prepared(files.sparkSession)
    df, n = frequencies(files, templates, text_col)
    shared = spark.sparkContext.broadcast(Templates(templates, df, n))
    kept = files.select(*key, F.col(text_col).cast("string").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches):
        t = shared.value
        for batch in batches:
            names, scores = [], []
            for _, words in word_hashes(batch.column(batch.num_columns - 1), PUNCT):
                found = t.notice(words)
                names.append(found[1] if found else None)
                scores.append(found[0] if found else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*key, "license", "score"])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in key) + ", license string, score double")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(found: DataFrame) -> DataFrame:
    """``found`` (path, license, ...) with ``effective`` and ``from_dir``: a file's own licence, or its nearest directory's.

    Several licence files of a directory: the best score, then the first name. A null path inherits nothing.
    """
    name = F.element_at(F.split("path", "/"), -1)
    held = (found.where(F.col("license").isNotNull() & name.rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
            .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")).select("dir", F.col("b.l").alias("dir_license")))
    own = found.withColumn("_dir", directory(F.col("path")))
    dirs = own.where("path IS NOT NULL").select(F.col("_dir").alias("d")).distinct()
    parts = F.split("d", "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    climbs = dirs.select("d", F.explode(F.array_distinct(up)).alias("dir"))
    near = (climbs.join(held, "dir").groupBy("d").agg(F.max(F.struct(F.length("dir").alias("n"), F.col("dir").alias("dir"), F.col("dir_license").alias("l"))).alias("b"))
            .select("d", F.col("b.dir").alias("near_dir"), F.col("b.l").alias("near_license")))
    full = own.join(near, own["_dir"] == near["d"], "left")
    return full.select(*found.columns, F.coalesce("license", "near_license").alias("effective"), F.when(F.col("license").isNull(), F.col("near_dir")).alias("from_dir"))


def scan(files: DataFrame, templates=TEMPLATES, key: tuple[str, ...] = ("path",), text_col: str = "text") -> DataFrame:
    """Key columns (``path`` among them), license, score, effective and from_dir, one row per input row.

    Null and empty texts have no notice; repeated rows and files agree; an empty table gives no rows; columns beside
    the key and the text are ignored. Texts and lines of any length are read in whole.
    """
    return inherited(written(notices(files, templates, key, text_col), "notices"))


def tree(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, text)``: the file tree that ``documents`` stand for, ``source/lang/thousand/hundred/name``.

    A text of at most 200 characters plays a LICENSE file, any other a text file named by its id.
    """
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.when(F.length("text") <= 200, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), part(1000), part(100), name).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of all ``documents``."""
    return scan(tree(read(spark, sf_dir, "documents")), key=("doc_id", "path"))
