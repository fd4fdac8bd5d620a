"""Chat formatting: a hidden Markov model over the lines of a transcript, Viterbi, then canonical turns.

States are (role, first line of a turn or a later one). A line shows a speaker marker (or none), its length,
whether it ends as a question and whether the line before was blank. All probabilities are smoothed counts over
every labelled line.

All lines are dealt in ranges of (conversation, position, line), so a transcript or a turn with a third of all lines
spreads over many tasks. A task walks its sorted range once and cuts each transcript into blocks of at most
``BLOCK_LINES`` lines and about ``BLOCK_CHARS`` characters; a block is one row of arrays. It tells each block what the
line before it was; only the first block of a task has to ask the last one of the task before. Viterbi is a product of
(max, +) matrices, which is associative: each block of a cut transcript gives its states x states matrix, the matrices
of a task are multiplied, the products fix the states at the borders of tasks, then those fix the borders of blocks, and
each block is decoded by itself. The result is that of one pass over the whole transcript, wherever the cuts lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import prepared, read, written

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2r: first line of a turn of role r, 2r + 1: a later line
#: Speaker markers at the start of a line, and a name for each family (fixed values).
MARKERS = (("system", r"(?:system|context|setup|### system)\s*:|<\|system\|>"),
           ("user", r"(?:user|human|customer|q|### instruction)\s*:|<\|user\|>"),
           ("assistant", r"(?:assistant|ai|bot|agent|a|### response)\s*:|<\|assistant\|>"),
           ("other", r"[A-Z][A-Za-z]{1,15}\s*:"))
LENGTHS = (0, 20, 60, 120, 240, 480)  # length classes start here
#: Symbols of the three emissions: marker, length class, and question x after a blank line.
SIZES = (len(MARKERS) + 1, len(LENGTHS), 4)
#: Lines and characters of a task, about, and of a block (which holds one line at least).
TASK_LINES, TASK_CHARS, BLOCK_LINES, BLOCK_CHARS = 20_000, 8_000_000, 512, 64_000
#: Number of a task's first block is the task's number times this.
TASK = 1 << 32


def _marker(line: Column) -> tuple[Column, Column]:
    """Marker family of a line (0: none), and the line without its marker."""
    kind, rest = F.lit(0), line
    for k, (name, pattern) in reversed(list(enumerate(MARKERS, 1))):
        full = rf"^\s*(?:{pattern if name == 'other' else '(?i)' + pattern})\s*"
        kind = F.when(line.rlike(full), k).otherwise(kind)
        if name != "other":  # an unknown name may be ordinary text and stays
            rest = F.when(line.rlike(full), F.regexp_replace(line, full, "")).otherwise(rest)
    return kind, rest


def featured(lines: DataFrame) -> DataFrame:
    """``(conv_id, pos, line, f0, f1, f2, blank, s)`` of ``(conv_id, pos, text)``; a null line is empty.

    ``f2`` tells only of the question as yet; ``s`` is the state that columns ``role`` and ``first`` name, -1 where they
    are absent or unknown. Rows with a null conversation or position take no part.
    """
    text = F.coalesce("text", F.lit(""))
    kind, rest = _marker(text)
    size = F.length(F.trim(text))
    longer = sum(((size >= n).cast("int") for n in LENGTHS[1:]), F.lit(0))
    s = F.lit(-1)
    if {"role", "first"} <= set(lines.columns):
        at = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
        s = F.when((at > 0) & F.col("first").isNotNull(), 2 * (at - 1) + F.when(F.col("first"), 0).otherwise(1)).otherwise(-1)
    return (lines.select(F.col("conv_id").cast("long"), F.col("pos").cast("long"), rest.alias("line"), kind.cast("int").alias("f0"), longer.cast("int").alias("f1"),
                         F.trim(text).endswith("?").cast("int").alias("f2"), (F.trim(text) == "").cast("int").alias("blank"), s.cast("int").alias("s"))
            .where("conv_id IS NOT NULL AND pos IS NOT NULL"))


BLOCKS = ("conv_id long, block long, head boolean, whole boolean, edge boolean, n int, pos array<long>, lines array<string>, "
          "f array<int>, s array<int>, before int, blank int, last int")


def blocked(lines: DataFrame, task_lines: int = TASK_LINES, task_chars: int = TASK_CHARS, block_lines: int = BLOCK_LINES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of featured lines in order; lines that repeat a position are ordered by their text. Written once.

    ``f`` holds three symbols a line; ``head``: a transcript begins here; ``whole``: it also ends here; ``before``: state
    label of the line before, -1 if unknown.
    """
    spark = prepared(lines.sparkSession)
    size = lines.agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("c")).first()
    tasks = max(1, math.ceil(size["n"] / task_lines), math.ceil((size["c"] or 0) / task_chars))
    # Equal rows differ in their number alone, so even one line repeated without end is cut.
    keys = ["conv_id", "pos", "line", "f0", "f1", "f2", "blank", "s", "number"]
    dealt = lines.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() * TASK
        first, held, chars, began, out, out_chars, behind = True, [], 0, False, [], 0, (-1, 0)  # behind: label and blankness of the line before the held ones

        def closed(more: bool, edge: bool) -> tuple:
            conv = held[0][0]
            f = np.array([r[3:6] for r in held], np.int32)
            blanks = np.array([behind[1], *[r[6] for r in held]], np.int32)
            f[:, 2] += 2 * blanks[:-1]
            return (conv, block, began, began and not more and not edge, edge, len(held), [r[1] for r in held], [r[2] for r in held], f.ravel().tolist(), [r[7] for r in held], behind[0],
                    held[-1][6], held[-1][7])

        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in BLOCKS.split(",")])

        for pdf in batches:
            for row in pdf[["conv_id", "pos", "line", "f0", "f1", "f2", "blank", "s"]].itertuples(index=False, name=None):
                same = bool(held) and held[0][0] == row[0]
                if held and (not same or len(held) >= block_lines or chars + len(row[2]) > block_chars):
                    out.append(closed(same, first))
                    out_chars += chars
                    block, behind, began, first = block + 1, (held[-1][7], held[-1][6]) if same else (-1, 0), not same, False
                    held, chars = [], 0
                held.append(row)
                chars += len(row[2])
                if out_chars > 16 * block_chars or len(out) >= 256:
                    yield frame(out)
                    out, out_chars = [], 0
        if held:
            out.append(closed(False, True))
        yield frame(out)

    found = written(dealt.drop("number").mapInPandas(cut, BLOCKS), "blocks")
    # The first block of a task follows the last of the task before; both are edges, so at most two rows a task meet here.
    w = W.partitionBy("conv_id").orderBy("block")
    edges = found.where("edge").select("conv_id", "block", F.lag("blank").over(w).alias("b"), F.lag("last").over(w).alias("l"))
    opens = edges.where(F.col("block") % TASK == 0).select("conv_id", "block", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("l", F.lit(-1)).alias("l"), F.col("b").isNull().alias("h"))
    starts = F.col("block") % TASK == 0
    fixed = found.where(starts).join(opens, ["conv_id", "block"]).select(
        "conv_id", "block", F.col("h").alias("head"), "whole", "edge", "n", "pos", "lines",
        F.transform("f", lambda x, i: F.when(i == 2, x + 2 * F.col("b")).otherwise(x)).alias("f"), "s", F.col("l").alias("before"), "blank", "last")
    return found.where(~starts).unionByName(fixed)


class Hmm:
    """Log probabilities: start (S), step (S x S), and emission tables (S x size)."""

    def __init__(self, start, step, emit):
        self.start, self.step, self.emit = start, step, emit

    def scores(self, f: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][:, f[:, k]].T for k in range(len(SIZES)))


def _allowed() -> np.ndarray:
    """A later line follows a line of its own turn's role; a first line follows anything."""
    ok = np.zeros((STATES, STATES), bool)
    ok[:, ::2] = True
    for r in range(len(ROLES)):
        ok[2 * r, 2 * r + 1] = ok[2 * r + 1, 2 * r + 1] = True
    return ok


def learn(blocks: DataFrame) -> Hmm:
    """The model of labelled blocks; lines without a known state don't count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = {"start": np.zeros((1, STATES), np.int64), "step": np.zeros((STATES, STATES), np.int64), **{f"f{k}": np.zeros((STATES, n), np.int64) for k, n in enumerate(SIZES)}}
        for pdf in batches:
            for head, before, f, s in pdf[["head", "before", "f", "s"]].itertuples(index=False, name=None):
                f, s = np.asarray(f, np.int64).reshape(-1, len(SIZES)), np.asarray(s, np.int64)
                known = s >= 0
                for k in range(len(SIZES)):
                    np.add.at(cells[f"f{k}"], (s[known], f[known, k]), 1)
                if head and s[0] >= 0:
                    cells["start"][0, s[0]] += 1
                p = np.append(-1 if head else before, s[:-1])
                both = known & (p >= 0)
                np.add.at(cells["step"], (p[both], s[both]), 1)
        yield pd.DataFrame([(t, a, b, int(x[a, b])) for t, x in cells.items() for a, b in zip(*np.nonzero(x), strict=True)], columns=["t", "a", "b", "n"])

    found = blocks.select("head", "before", "f", "s").mapInPandas(count, "t string, a int, b int, n long")
    rows = found.groupBy("t", "a", "b").agg(F.sum("n").alias("n")).collect()  # a few hundred cells at most
    start, step, emit = np.ones(STATES), np.where(_allowed(), 1.0, 0.0), [np.full((STATES, n), 0.5) for n in SIZES]
    start[1::2] = 0
    for r in rows:
        if r["t"] == "start":
            start[r["b"]] += r["n"] if r["b"] % 2 == 0 else 0
        elif r["t"] == "step":
            step[r["a"], r["b"]] += r["n"] if _allowed()[r["a"], r["b"]] else 0
        else:
            emit[int(r["t"][1])][r["a"], r["b"]] += r["n"]
    with np.errstate(divide="ignore"):
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return Hmm(norm(start), norm(step), [norm(e) for e in emit])


def transfer(m: Hmm, e: np.ndarray, first: bool) -> np.ndarray:
    """Best score from each state before a block (the start, for a first block) to each state at its end."""
    t = (m.start[None, :] if first else m.step) + e[0][None, :]
    for row in e[1:]:
        t = (t[:, :, None] + m.step[None, :, :]).max(axis=1) + row[None, :]
    return t


def decode(m: Hmm, e: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
    """Viterbi states of a block, given the state before it and the one at its end (None: free); ties to the lower state."""
    n = len(e)
    v = (m.start if before is None else m.step[before]) + e[0]
    back = np.zeros((n, STATES), np.int8)
    for k in range(1, n):
        both = v[:, None] + m.step
        back[k] = both.argmax(axis=0)
        v = both.max(axis=0) + e[k]
    out = np.zeros(n, np.int64)
    out[-1] = v.argmax() if last is None else last
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k][out[k]]
    return out


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """(max, +) product of matrices in order."""
    t = matrices[0]
    for x in matrices[1:]:
        t = (t[:, :, None] + x[None, :, :]).max(axis=1)
    return t


def chain(matrices: list[np.ndarray], before: int, last: int) -> list[tuple[int, int]]:
    """(state before, state at the end) of each matrix on the best way from ``before`` to ``last``; -1: the start, or free."""
    scores, links = matrices[0][max(before, 0)], []
    for t in matrices[1:]:
        both = scores[:, None] + t
        links.append(both.argmax(axis=0))
        scores = both.max(axis=0)
    ends = [int(scores.argmax()) if last < 0 else last]
    for link in reversed(links):
        ends.append(int(link[ends[-1]]))
    ends = ends[::-1]
    return list(zip([before, *ends[:-1]], ends, strict=True))


def _borders(blocks: DataFrame, shared) -> DataFrame:
    """``(conv_id, block, before, end)``: the states before and at the end of every block of the transcripts that are cut.

    In two levels, so no task holds all blocks of a transcript: the blocks of a task, then one product a task.
    """
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            t = [transfer(m, m.scores(np.asarray(f).reshape(-1, len(SIZES))), bool(head)).ravel().tolist() for head, f in zip(pdf["head"], pdf["f"], strict=True)]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], "t": t}, columns=["conv_id", "block", "t"])

    as_matrices = lambda pdf: [np.array(t).reshape(-1, STATES) for t in pdf["t"]]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "task": pdf["task"].iloc[:1], "t": [product(as_matrices(pdf)).ravel().tolist()]})

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        return pd.DataFrame([(c, k, b, e) for c, k, (b, e) in zip(pdf["conv_id"], pdf["task"], chain(as_matrices(pdf), -1, -1), strict=True)], columns=["conv_id", "task", "b", "e"])

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ways = chain(as_matrices(pdf), int(pdf["b"].iloc[0]), int(pdf["e"].iloc[0]))
        return pd.DataFrame([(c, k, b, e) for c, k, (b, e) in zip(pdf["conv_id"], pdf["block"], ways, strict=True)], columns=["conv_id", "block", "before", "end"])

    t = blocks.select("conv_id", "block", "head", "f").mapInPandas(matrices, "conv_id long, block long, t array<double>")
    t = written(t.withColumn("task", F.floor(F.col("block") / TASK)), "matrices")
    ends = (t.groupBy("conv_id", "task").applyInPandas(products, "conv_id long, task long, t array<double>")
            .groupBy("conv_id").applyInPandas(outer, "conv_id long, task long, b int, e int"))
    return t.join(ends, ["conv_id", "task"]).groupBy("conv_id", "task").applyInPandas(inner, "conv_id long, block long, before int, end int")


def states(blocks: DataFrame, model: Hmm) -> DataFrame:
    """``(conv_id, block, whole, pos, lines, states)``: every block with its lines' Viterbi states."""
    shared = prepared(blocks.sparkSession).sparkContext.broadcast(model)
    # A transcript that lies in one block needs no borders, and its text doesn't travel again.
    cut = blocks.where("NOT whole")
    borders = _borders(cut, shared)
    some = cut.join(borders.withColumnRenamed("before", "b"), ["conv_id", "block"]).select("conv_id", "block", "whole", "pos", "lines", "f", "b", "end")
    every = blocks.where("whole").select("conv_id", "block", "whole", "pos", "lines", "f", F.lit(-1).alias("b"), F.lit(-1).alias("end")).unionByName(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            found = [decode(m, m.scores(np.asarray(f).reshape(-1, len(SIZES))), None if b < 0 else int(b), None if e < 0 else int(e)).tolist()
                     for f, b, e in zip(pdf["f"], pdf["b"], pdf["end"], strict=True)]
            yield pdf[["conv_id", "block", "whole", "pos", "lines"]].assign(states=pd.Series(found, index=pdf.index, dtype=object))

    return every.mapInPandas(run, "conv_id long, block long, whole boolean, pos array<long>, lines array<string>, states array<int>")


def roles(blocks: DataFrame, model: Hmm) -> DataFrame:
    """``(conv_id, pos, line, state)``: the Viterbi state of every line."""
    one = F.explode(F.arrays_zip("pos", "lines", "states")).alias("x")
    return states(blocks, model).select("conv_id", one).select("conv_id", "x.pos", F.col("x.lines").alias("line"), F.col("x.states").alias("state"))


def turns(found: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, rendered)``: canonical turns of ``states``, numbered from 0.

    A turn starts where the state says so (and with the transcript). Its lines are joined by line breaks without the
    marker, outer white space off, and rendered ``<|role|>``, text, ``<|end|>``. A turn's text is gathered in one row.
    """
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, block, whole, lines, path in pdf[["conv_id", "block", "whole", "lines", "states"]].itertuples(index=False, name=None):
                path = np.asarray(path)
                starts = np.flatnonzero(path % 2 == 0)
                cuts = [0, *[x for x in starts.tolist() if x], len(path)]
                k = 0 if len(starts) and starts[0] == 0 else -1  # -1: goes on with a turn of an earlier block
                for a, b in zip(cuts, cuts[1:], strict=False):
                    out.append((conv, block, whole, k, int(path[a]) // 2, "\n".join(lines[a:b])))
                    k += 1
            yield pd.DataFrame(out, columns=["conv_id", "block", "whole", "k", "r", "text"])

    parts = found.mapInPandas(pieces, "conv_id long, block long, whole boolean, k int, r int, text string")
    parts = written(parts.withColumn("task", F.floor(F.col("block") / TASK)), "turns")
    # Turns begun before a block: those of earlier tasks, then of earlier blocks of its task.
    cut = parts.where("NOT whole")
    counts = cut.groupBy("conv_id", "task", "block").agg(F.sum((F.col("k") >= 0).cast("long")).alias("n"))
    run = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = counts.groupBy("conv_id", "task").agg(F.sum("n").alias("n")).select("conv_id", "task", run(W.partitionBy("conv_id").orderBy("task")).alias("t"))
    before = (counts.withColumn("b", run(W.partitionBy("conv_id", "task").orderBy("block"))).join(tasks, ["conv_id", "task"])
              .select("conv_id", "block", (F.col("b") + F.col("t")).alias("earlier")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    some = (cut.join(before, ["conv_id", "block"]).groupBy("conv_id", (F.col("earlier") + F.col("k")).alias("turn")).agg(F.max("r").alias("r"), joined.alias("text")))
    out = parts.where("whole").select("conv_id", F.col("k").cast("long").alias("turn"), "r", "text").unionByName(some)
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("r") + 1)
    out = out.select("conv_id", "turn", role.alias("role"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")))


#: Positions kept for a turn's lines.
TURN_LINES = 1 << 32
STYLES = {"system": ("System: ", "Context: ", "<|system|> ", "### System: "), "user": ("User: ", "Human: ", "<|user|> ", "### Instruction: "),
          "assistant": ("Assistant: ", "AI: ", "<|assistant|> ", "### Response: ")}


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines ``(conv_id, pos, text, role, first)`` of the transcripts that ``conversations`` stand for.

    Each conversation has one of four marker styles; one turn in eight (by a hash) has lost its marker. ``role`` and ``first`` are the truth.
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(4)).cast("int")
    marker = F.lit("")
    for role, forms in STYLES.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, forms)), style + 1)).otherwise(marker)
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit(2)), F.lit(8)) == 0
    text = F.concat(F.when(lost, "").otherwise(marker), F.coalesce("text", F.lit("")))
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return rows.select("conv_id", (F.col("turn") * TURN_LINES + F.col("i")).alias("pos"), F.col("line").alias("text"), "role", (F.col("i") == 0).alias("first"))


def op10_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the transcripts of all ``conversations``."""
    blocks = blocked(featured(transcripts(read(prepared(spark), sf_dir, "conversations"))))
    return turns(states(blocks, learn(blocks)))
