import math

import pytest

from tessera.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string"


def corpus(spark, sizes, words=5):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i := i + 1, " ".join(["w"] * (1 + i % (2 * words))), s))
    return rows, spark.createDataFrame(rows, SCHEMA)


def weights(rows, share, most, budget=None):
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    total = sum(tokens.values())
    spend = budget or total

    def at(a):
        w = {s: (n / total) ** a for s, n in tokens.items()}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    repeats = lambda w: max(w[s] * spend / tokens[s] for s in w)
    grid = [k / 2000 for k in range(2001)]
    a = max(x for x in grid if entropy(at(x)) >= share * math.log(len(tokens)) or x == 0)
    if repeats(at(a)) > most:
        a = min((x for x in grid if x >= a and repeats(at(x)) <= most), default=1.0)
    return tokens, at(a), spend


@pytest.mark.parametrize(("share", "most", "budget"), [(0.95, 4, None), (0.99, 1.5, None), (0.8, 100, 9000), (0.97, 3, 700)])
def test_weights_budgets_and_epochs(spark, share, most, budget):
    rows, docs = corpus(spark, {"big": 900, "mid": 150, "small": 40})
    tokens, want, spend = weights(rows, share, most, budget)
    got = mx.mix(docs, share, most, budget, block_docs=16).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    for s, n in tokens.items():
        own = [r for r in got if r.source == s]
        assert abs(own[0].weight - want[s]) < 2e-3
        target, used = own[0].weight * spend, sum(r.n_tokens for r in own)
        assert target - 1 <= used < target + 10 + 1  # the last document may run over
        ids = {}
        for r in own:
            assert r.n_tokens == size[r.doc_id] and 0 <= r.position < 1
            ids.setdefault(r.epoch, []).append(r.doc_id)
        assert all(len(v) == len(set(v)) for v in ids.values())
        for e in range(max(ids)):  # whole epochs come before the next one
            assert sum(size[i] for i in ids[e]) == n
        if len(ids) > 1 and len(ids[0]) == len(ids[1]) and len(ids[0]) > 30:
            order = lambda e: [r.doc_id for r in sorted(own, key=lambda r: r.position) if r.epoch == e]  # noqa: E731, B023
            assert order(0) != order(1)


@pytest.mark.parametrize("end", [0.0, 0.1, 0.3141592653589793, 0.999])
def test_bisection_asks_for_many_points_at_once(end):
    rounds = []

    def ok(points):
        rounds.append(len(points))
        return [x <= end for x in points]

    assert abs(mx.bisect(ok, 0.0, 1.0) - end) < 1e-11 and len(rounds) == 9
    assert mx.bisect(lambda points: [True for _ in points], 0.0, 1.0) == 1.0


def test_a_budget_beyond_the_limit_takes_the_corpus_weights(spark):
    rows, docs = corpus(spark, {"big": 90, "small": 10})
    tokens, _, _ = weights(rows, 0.9, 4)
    got = mx.mix(docs, 0.9, max_epochs=2, budget=5 * sum(tokens.values())).select("source", "weight").distinct().collect()
    assert all(abs(r.weight - tokens[r.source] / sum(tokens.values())) < 1e-9 for r in got)


def test_position_keeps_the_weights_throughout(spark):
    _, docs = corpus(spark, {"big": 2000, "small": 500})
    got = sorted(mx.mix(docs, 0.97, 4).collect(), key=lambda r: r.position)
    w = {r.source: r.weight for r in got}
    for part in (got[: len(got) // 4], got[len(got) // 4 : len(got) // 2]):
        n = sum(r.n_tokens for r in part)
        assert abs(sum(r.n_tokens for r in part if r.source == "big") / n - w["big"]) < 0.03


def test_same_rows_again(spark):
    _, docs = corpus(spark, {"a": 300, "b": 60})
    one, two = ({tuple(r) for r in mx.mix(d).collect()} for d in (docs, docs.repartition(5)))
    assert one == two


def test_odd_rows(spark):
    rows = [(1, "a b", None), (2, None, "x"), (3, "", "x"), (None, "c", "x"), (4, "d e f", "x"), (4, "d e f", "x"), (5, "w " * 300_000, "y")]
    got = mx.mix(spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", weight double"), budget=2_000_000, max_epochs=1e9, entropy_share=0.0).collect()
    assert {r.source for r in got} == {"", "x", "y"} and {r.doc_id for r in got} == {1, None, 4, 5}
    assert sum(r.doc_id == 4 and r.epoch == 0 for r in got) == 2
    assert mx.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mx.mix(spark.createDataFrame([(1, None, "x")], SCHEMA)).collect() == []
