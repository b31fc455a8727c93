"""Item similarity and neighbours by blocks of items, against plain loops."""

import itertools
import math
import random

import pytest

from tessera.operators import recommend
from tessera.plans import catalog


def rows_written(spark, run):
    """The most rows that any stage of ``run`` writes to a shuffle, and its result."""
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before), out


@pytest.fixture(scope="module")
def people():
    rng = random.Random(8)
    train = {(f"u{u:03d}", f"i{i:03d}"): rng.randint(1, 5) for u in range(200) for i in rng.sample(range(60 if u % 2 else 400), 12)}
    test = [(f"u{rng.randint(0, 205):03d}", f"i{rng.randint(0, 405):03d}") for _ in range(900)]
    return train, sorted(set(test))


def frames(spark, people):
    train, test = people
    return spark.createDataFrame([(*k, s) for k, s in train.items()], "user string, item string, stars long"), spark.createDataFrame([(*k, 3) for k in test], "user string, item string, stars long")


def loops(train):
    by, mean, out = {}, {}, {}
    for (u, i), s in train.items():
        by.setdefault(i, {})[u] = s
    mean = {i: sum(r.values()) / len(r) for i, r in by.items()}
    for a, b in itertools.combinations(sorted(by), 2):
        both = [(by[a][u], by[b][u]) for u in by[a].keys() & by[b].keys()]
        if both:
            n, sx, sy = len(both), sum(x for x, _ in both), sum(y for _, y in both)
            top = n * sum(x * y for x, y in both) - sx * sy
            below = (n * sum(x * x for x, _ in both) - sx * sx) * (n * sum(y * y for _, y in both) - sy * sy)
            value = min(mean[a], mean[b]) / max(mean[a], mean[b]) if n == 1 else top / math.sqrt(below) if top > 0 and below > 0 else 0.0
            out[a, b] = (n, value)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ROWS", 300), ("STEP_CELLS", 900), ("STEP_PAIRS", 500)):
        monkeypatch.setattr(recommend, name, value)


def test_pearson_matches_loops_and_shuffles_no_pairs(spark, people, small_blocks):
    ratings, want = frames(spark, people)[0], loops(people[0])
    most, got = rows_written(spark, lambda: recommend.pearson(ratings).collect())
    assert {(r.a, r.b): (r.n, pytest.approx(r.similarity)) for r in got} == want and len(got) == len(want)
    assert most < len(want) / 2


def test_nearest_matches_loops_and_shuffles_only_the_best(spark, people, small_blocks):
    (train, test), similar = people, loops(people[0])
    want = set()
    for u, i in test:
        near = [(-similar[p][1], j, s) for (v, j), s in train.items() if v == u and j != i and (p := (min(i, j), max(i, j))) in similar]
        want |= {(u, i, j, -x, s) for x, j, s in sorted(near)[:3]}
    most, got = rows_written(spark, lambda: recommend.nearest(*frames(spark, people)).collect())
    assert {(r.user, r.item, r.neighbour, r.similarity, r.stars) for r in got} == want and len(got) == len(want)
    assert most <= len(train) + len(test)


@pytest.mark.parametrize("name", ["top3_neighbours", "cf_predictions", "rmse", "error_histogram", "means_blend", "support_blend", "hybrid_predictions"])
def test_queries_shuffle_no_pairs(spark, name):
    d = "/root/testdata/sf0.01"
    most, got = rows_written(spark, lambda: catalog.QUERIES[name](spark, d).collect())
    assert got and most <= 60_000  # lines of orders; pairs of a user's items are over a million


def test_queries_deal_each_line_once_to_its_user(spark):
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    assert len(catalog.QUERIES["rmse"](spark, "/root/testdata/sf0.01").collect()) == 1
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    # lines and orders to their join, lines to their users, then lists only
    assert sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) <= 60_000 + 15_000 + 60_000 + 30_000


@pytest.mark.parametrize("small", [True, False])
def test_estimates_with_nulls_and_items_beyond_the_driver(spark, people, small, monkeypatch):
    monkeypatch.setattr(recommend, "SMALL_ITEMS", recommend.SMALL_ITEMS if small else 10)
    monkeypatch.setattr(recommend, "BLOCK_ROWS", 300)
    train, test = people
    kinds = "user string, item string, stars long"
    ratings = spark.createDataFrame([(*p, s) for p, s in train.items()] + [(None, "i001", 5), ("u001", None, 5)], kinds)
    asked = spark.createDataFrame([(*p, 3) for p in test] + [(None, "i001", 3), ("u001", None, 3), (None, None, 3)], kinds)
    got = {(r.user, r.item): r.prediction for r in recommend.cf_predictions(ratings, asked).collect()}
    plain = recommend.cf_predictions(ratings, asked, top=recommend.neighbours(ratings, asked, recommend.pearson(ratings)))
    assert got == {(r.user, r.item): pytest.approx(r.prediction) for r in plain.collect()} and len(got) == len(test) + 3
