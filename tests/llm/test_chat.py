"""Role recovery: Viterbi against all paths, blocks against one pass, held-out accuracy, rendering, edge rows."""

import itertools

import numpy as np
from conftest import SF01

from cordon.llm import chat_roles as c
from cordon.llm.tables import read


def model(seed=0):
    rng = np.random.default_rng(seed)
    step = np.where(c._allowed(), rng.random((c.STATES, c.STATES)), 0)
    start = rng.random(c.STATES)
    start[1::2] = 0
    with np.errstate(divide="ignore"):
        return c.Hmm(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(rng.dirichlet(np.ones(n), c.STATES)) for n in c.SIZES])


def features(seed, n):
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, s, n) for s in c.SIZES], axis=1)


def score(m, e, path):
    return m.start[path[0]] + e[0][path[0]] + sum(m.step[a, b] + e[k][b] for k, (a, b) in enumerate(zip(path, path[1:]), 1))


def test_viterbi_equals_all_paths():
    for seed in range(5):
        m = model(seed)
        e = m.scores(features(seed, 4))
        best = max(score(m, e, p) for p in itertools.product(range(c.STATES), repeat=4))
        assert abs(score(m, e, c.decode(m, e, None, None)) - best) < 1e-9


#: Cuts: (lines of a task, characters of a task, lines of a block, characters of a block).
WHOLE, SMALL = (1 << 30, 1 << 40, 1 << 30, 1 << 40), [(7, 1 << 40, 3, 1 << 40), (40, 1 << 40, 5, 60), (5, 1 << 40, 100, 1 << 40), (1 << 30, 300, 1, 1)]


def text_lines(seed, n):
    """A transcript by itself: markers, blank lines, questions."""
    rng = np.random.default_rng(seed)
    forms = ["User: ", "AI: ", "System: ", "Bob: ", "", "", "", ""]
    return ["" if rng.random() < 0.2 else forms[rng.integers(8)] + "w " * int(rng.integers(0, 40)) + ("?" if rng.random() < 0.3 else "") for _ in range(n)]


def labelled(spark):
    rows = [(conv, k, t, ("system", "user", "assistant", None, "x")[(k // 3 + conv) % 5], k % 3 == 0)
            for conv, n in ((1, 7), (2, 300), (3, 1), (4, 60), (5, 2)) for k, t in enumerate(text_lines(conv, n))]
    return spark.createDataFrame(rows, "conv_id long, pos long, text string, role string, first boolean")


def test_features_and_counts_do_not_depend_on_the_cuts(spark):
    """Text cut anywhere has the symbols, the model and the states of one pass over each transcript."""
    rows = labelled(spark)
    one = c.blocked(c.featured(rows), *WHOLE)
    m = c.learn(one)
    line_of = lambda b: {(r.conv_id, p): (t, *r.f[3 * k: 3 * k + 3]) for r in b.collect() for k, (p, t) in enumerate(zip(r.pos, r.lines))}
    state_of = lambda b: {(r.conv_id, r.pos): r.state for r in c.roles(b, m).collect()}
    turns_of = lambda b: sorted(map(tuple, c.turns(c.states(b, m)).collect()))
    want, path, rendered = line_of(one), state_of(one), turns_of(one)
    e = {conv: m.scores(np.array([want[k][1:] for k in sorted(want) if k[0] == conv])) for conv in range(1, 6)}
    for conv, scores in e.items():  # one pass over the whole transcript
        assert [path[k] for k in sorted(path) if k[0] == conv] == c.decode(m, scores, None, None).tolist()
    raw = {(r.conv_id, r.pos): r.text for r in rows.collect()}
    for (conv, pos), (_, _, _, f2) in want.items():
        assert (f2 >= 2) == (pos > 0 and raw[conv, pos - 1].strip(" ") == "") and f2 % 2 == raw[conv, pos].strip(" ").endswith("?")
    for cuts in SMALL:
        b = c.blocked(c.featured(rows), *cuts)
        assert b.count() > 5 and line_of(b) == want
        again = c.learn(b)
        assert all((x == y).all() for x, y in zip([m.start, m.step, *m.emit], [again.start, again.step, *again.emit]))
        got = state_of(b)
        for conv, scores in e.items():  # equal up to ties
            mine = [got[k] for k in sorted(got) if k[0] == conv]
            assert abs(score(m, scores, mine) - score(m, scores, [path[k] for k in sorted(path) if k[0] == conv])) < 1e-9
        if got == path:
            assert turns_of(b) == rendered


def test_learned_counts_equal_a_plain_count(spark):
    rows = labelled(spark)
    m = c.learn(c.blocked(c.featured(rows), 9, 1 << 40, 4, 1 << 40))
    step, start, by = np.where(c._allowed(), 1.0, 0.0), np.array([1.0, 0.0] * 3), {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.pos)):
        by.setdefault(r.conv_id, []).append(2 * c.ROLES.index(r.role) + (not r.first) if r.role in c.ROLES else -1)
    for path in by.values():
        start[path[0]] += path[0] >= 0 and path[0] % 2 == 0
        for a, b in zip(path, path[1:]):
            if a >= 0 and b >= 0 and c._allowed()[a, b]:
                step[a, b] += 1
    with np.errstate(divide="ignore"):
        assert np.allclose(m.start, np.log(start / start.sum()))
        assert np.allclose(m.step, np.log(step / step.sum(axis=1, keepdims=True)))


def test_held_out_roles(spark):
    """Fitted on even conversations, lines of odd ones get their role; turns with a marker nearly always."""
    rows = c.transcripts(read(spark, SF01, "conversations"))
    m = c.learn(c.blocked(c.featured(rows.where("conv_id % 2 = 0"))))
    odd = c.featured(rows.where("conv_id % 2 = 1"))
    got = c.roles(c.blocked(odd, 50, 1 << 40, 7), m).join(odd.select("conv_id", "pos", "s", "f0"), ["conv_id", "pos"]).collect()
    assert len(got) == odd.count()
    assert sum(r.state // 2 == r.s // 2 for r in got) >= 0.9 * len(got)
    marked = [r for r in got if r.s % 2 == 0 and r.f0]
    assert sum(r.state == r.s for r in marked) >= 0.98 * len(marked)


def lines(spark, rows, *cuts):
    return c.blocked(c.featured(spark.createDataFrame(rows, "conv_id long, pos long, text string")), *cuts)


def test_turns_and_rendering(spark):
    m = c.learn(c.blocked(c.featured(c.transcripts(read(spark, SF01, "conversations")))))
    rows = [(1, 0, "System: be kind"), (1, 1, "Human: hello"), (1, 2, "are you there?"), (1, 3, "AI: yes"), (1, 4, ""), (1, 5, "User: fine"),
            (2, 0, None), (None, 0, "User: x"), (3, None, "User: x")]
    for cuts in ((), (2, 1 << 40, 1)):
        got = [tuple(r) for r in c.turns(c.states(lines(spark, rows, *cuts), m)).orderBy("conv_id", "turn").collect()]
        assert [r[:4] for r in got[:4]] == [(1, 0, "system", "be kind"), (1, 1, "user", "hello\nare you there?"), (1, 2, "assistant", "yes"), (1, 3, "user", "fine")]
        assert [r[0] for r in got] == [1, 1, 1, 1, 2] and got[4][3] == ""
        assert got[0][4] == "<|system|>\nbe kind\n<|end|>"


def test_repeated_rows_and_no_rows(spark):
    m = model()
    twice = [(1, 0, "User: a"), (1, 0, "User: a"), (1, 1, "AI: " + "b " * 60_000)]
    assert c.roles(lines(spark, twice), m).count() == 3
    clash = spark.createDataFrame([(1, 0, "a", 5, "x")], "conv_id long, pos long, text string, block long, s string")
    assert c.roles(c.blocked(c.featured(clash)), m).count() == 1
    assert c.turns(c.states(lines(spark, []), m)).count() == 0
    assert np.isfinite(c.learn(lines(spark, [])).emit[0]).all()


def test_one_line_repeated_is_cut(spark):
    """A position that holds equal lines without end spreads over tasks and blocks."""
    rows = spark.range(6000).selectExpr("1L AS conv_id", "0L AS pos", "'User: a' AS text")
    b = c.blocked(c.featured(rows), 500, 1 << 40, 100)
    sizes = b.selectExpr("n", "block >> 32 AS task").collect()
    tasks = {}
    for r in sizes:
        tasks[r.task] = tasks.get(r.task, 0) + r.n
    assert sum(tasks.values()) == 6000 and len(tasks) >= 8 and max(tasks.values()) <= 1500 and max(r.n for r in sizes) <= 100
    assert c.roles(b, model()).count() == 6000
