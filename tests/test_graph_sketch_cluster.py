import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import PRIME, coefficients, folded, trailing_zeros
from tessera.operators import cluster, graph, recommend, similarity, sketches
from tessera.sources import writers

#: Two groups of four that 3-10 joins, and a tail 12-20.
EDGES = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (3, 10), (10, 11), (10, 12), (10, 13), (11, 13), (12, 13), (12, 20)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(EDGES, "u long, v long")


def shortest_paths(a, b):
    """All shortest paths, by trying every simple path."""
    near = {x: [v if u == x else u for u, v in EDGES if x in (u, v)] for e in EDGES for x in e}
    found, paths = [], [[a]]
    while paths and not found:
        paths = [[*p, x] for p in paths for x in near[p[-1]] if x not in p]
        found = [p for p in paths if p[-1] == b]
    return found


def brute_betweenness():
    out = dict.fromkeys(EDGES, 0.0)
    nodes = sorted({x for e in EDGES for x in e})
    for a, b in itertools.combinations(nodes, 2):
        paths = shortest_paths(a, b)
        for p in paths:
            for e in itertools.pairwise(p):
                out[min(e), max(e)] += 1 / len(paths)
    return out


def test_betweenness_both_ways(small):
    want = brute_betweenness()
    for rows in (graph.betweenness(small).collect(), graph._betweenness_by_joins(small).collect()):
        assert {(r.u, r.v): r.betweenness for r in rows} == pytest.approx(want)
    assert writers.betweenness_lines(graph.betweenness(small)).head().value == "('3', '10'), 20.0"


def test_division_and_modularity(small):
    want = {"0,1,2,3", "10,11,12,13,20"}
    parts = graph.divided(small)
    assert {r.members for r in graph.communities(parts, "component").collect()} == want
    assert {r.members for r in graph.communities(graph.divided_by_joins(small), "component").collect()} == want
    of = {r.vertex: r.component for r in parts.collect()}
    degree, m = {x: sum(x in e for e in EDGES) for x in of}, len(EDGES)
    q = sum((((i, j) in EDGES) - degree[i] * degree[j] / (2 * m)) / (2 * m) for i, j in itertools.combinations(sorted(of), 2) if of[i] == of[j])
    assert graph.modularity(small, parts).head()[0] == pytest.approx(q)
    assert [r.value for r in writers.community_lines(graph.communities(parts, "component")).collect()][0] == "'0', '1', '2', '3'"


def test_components_and_labels(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "u long, v long")
    assert {r.vertex: r.component for r in graph.connected_components(chain).collect()} == {i: 0 if i <= 20 else 21 for i in range(41)}
    clique = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "u long, v long")
    assert {r.label for r in graph.label_propagation(clique).collect()} == {0}


def test_bloom_and_reservoir_equal_the_loops(spark):
    rng = random.Random(1)
    users = [rng.randint(1, 900) for _ in range(1500)]
    df = spark.createDataFrame([(i, i // 100, u) for i, u in enumerate(users)], "seq long, batch long, user long")
    bits, seen, held, want = 997, set(), set(), {}
    for i, u in enumerate(users):
        if u in seen:
            continue
        at = {(u * a + b) % PRIME % bits for a, b in coefficients(5)}
        fp = at <= held
        x = want.setdefault(i // 100, [0, 0])
        x[0 if fp else 1] += 1
        held |= at
        seen.add(u)
    got = {r.batch: [r.fp, r.tn] for r in sketches.bloom_fpr(df, bits).collect()}
    assert {k: v for k, v in got.items() if v != [0, 0]} == want
    (a, b), (c, d) = coefficients(2)
    sample, want = [], {}
    for i, u in enumerate(users):
        n = i + 1
        if n <= 50:
            sample.append(u)
        elif (n * a + b) % PRIME * n < PRIME * 50:
            sample[(n * c + d) % PRIME % 50] = u
        want[i // 100] = list(sample)
    for r in sketches.reservoir(df, 50, [0, 20, 40]).collect():
        assert want[r.batch][r.slot] == r.user


def test_fm_is_near_the_truth(spark):
    df = spark.range(2000).select(F.col("id").alias("seq"), F.lit(0).alias("batch"), (F.col("id") % 700).alias("user"))
    r = sketches.fm_estimate(df, hashes=15).head()
    assert r.truth == 700 and 100 < r.estimate < 5000


def test_hash_helpers(spark):
    assert spark.createDataFrame([("hG7b0",)], "s string").select(folded(F.col("s"), 9973)).head()[0] == 7347
    got = spark.createDataFrame([(0,), (1,), (8,), (12,)], "x long").select(trailing_zeros(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 0, 3, 2]


def test_cold_start_and_pearson_rules(spark):
    train = spark.createDataFrame([(1, 1, 4), (1, 2, 2), (2, 1, 2), (3, 3, 5)], "user long, item long, stars long")
    test = spark.createDataFrame([(9, 9, 1), (1, 9, 1), (9, 1, 1), (1, 3, 1)], "user long, item long, stars long")
    assert {(r.user, r.item): r.prediction for r in recommend.cold_start(train, test).collect()} == {(9, 9): 3.0, (1, 9): 3.0, (9, 1): 3.0}
    p = recommend.pearson(train).head()
    assert (p.a, p.b, p.n) == (1, 2, 1) and p.similarity == pytest.approx(2 / 3)


def test_lsh_finds_similar_sets(spark):
    rows = [(d, f"t{i}") for d, base in ((1, 0), (2, 2), (3, 500)) for i in range(base, base + 60)]
    sets = spark.createDataFrame(rows, "doc long, token string")
    cand = similarity.candidates(similarity.bands(similarity.signatures(sets, 100), 4))
    assert [(r.a, r.b, round(r.similarity, 4)) for r in similarity.jaccard(sets, cand, 0.5).collect()] == [(1, 2, round(58 / 62, 4))]


def test_bfr_separates_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(20 * (i % 3), 0.5), rng.gauss(-15 * (i % 3), 0.5)]) for i in range(300)] + [(1000, [500.0, 500.0])]
    report, out = cluster.bfr(spark.createDataFrame(rows, "idx long, f array<double>"), 3)
    labels = {r.idx: r.cluster for r in out.collect()}
    assert len(labels) == 301 and labels[1000] == -1
    for k in range(3):
        own = [labels[i] for i in range(k, 300, 3) if labels[i] != -1]
        assert len(own) > 80 and len(set(own)) == 1
    seen = [r.n_ds + r.n_cs + r.n_rs for r in report.orderBy("round").collect()]
    assert seen == sorted(seen) and seen[-1] == 301


def test_bfr_reports_what_it_labels_when_merges_chain(spark, monkeypatch):
    """Every compression cluster is within reach of every other, and of the discard clusters at the end."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * 40 ** rng.random(), rng.gauss(0, 1) * 40 ** rng.random()]) for i in range(300)]
    monkeypatch.setattr(cluster._Summary, "far", lambda self, other: 0.0)
    report, out = cluster.bfr(spark.createDataFrame(rows, "idx long, f array<double>"), 2, rounds=2)
    last = report.orderBy("round").collect()[-1]
    assert last.n_ds == out.where("cluster <> -1").count() and last.n_cs == 0 and last.n_ds + last.n_rs == 300


def test_nearest_matches_a_loop(spark):
    rng = random.Random(9)
    pts = [(i, [rng.uniform(-9, 9) for _ in range(3)]) for i in range(60)]
    cls = [(c, [rng.uniform(-9, 9) for _ in range(3)], [rng.choice((0.0, 1.0, 2.5)) for _ in range(3)]) for c in (4, 2, 9)]
    clusters = spark.createDataFrame(cls, "cluster long, mean array<double>, dev array<double>")
    points = spark.createDataFrame(pts, "idx long, f array<double>")
    far = lambda f, m, s: sum(((a - b) / c) ** 2 for a, b, c in zip(f, m, s, strict=True) if c) ** 0.5
    want = {i: min((far(f, m, s), c) for c, m, s in cls) for i, f in pts}
    got = {r.idx: (r.distance, r.cluster) for r in cluster.nearest(points, clusters).collect()}
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert all(got[i][0] == pytest.approx(want[i][0]) for i in want)
    assert cluster.nearest(points, clusters.limit(0)).collect() == []


def test_streams(spark, tmp_path):
    from tessera.streaming import sketches as live

    rng = random.Random(7)
    rows = [(i, rng.randint(1, 400)) for i in range(600)]
    for b in range(3):
        spark.createDataFrame(rows[b * 200 : b * 200 + 200], "seq long, user long").coalesce(1).write.parquet(str(tmp_path / f"in/b={b}"))
    src = lambda: spark.readStream.schema("seq long, user long, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("bloom_out", live.bloom_stream(src(), bits=499)), ("sample_out", live.reservoir_stream(src(), 50))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    batch = spark.createDataFrame([(i, i // 200, u) for i, u in rows], "seq long, batch long, user long")
    want = sketches.bloom_fpr(batch, 499).agg(F.sum("fp"), F.sum("tn")).head()
    assert tuple(spark.sql("select sum(fp), sum(tn) from bloom_out").head()) == tuple(want)
    last = spark.sql("select sample from sample_out order by n desc").head().sample
    for r in sketches.reservoir(batch, 50, [0, 20, 40]).where("batch = 2").collect():
        assert last[r.slot] == r.user
