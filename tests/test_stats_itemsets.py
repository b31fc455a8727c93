import itertools
import math
import random
from types import SimpleNamespace

import duckdb
import pytest

from tessera.functions.ids import dense_ids
from tessera.functions.storage import shared_dir
from tessera.operators import itemsets, recommend, stats
from tessera.sources import readers, writers


def brute(baskets, support):
    own = {}
    for b, i in baskets:
        own.setdefault(b, set()).add(i)
    out, k = {}, 1
    while True:
        count = {}
        for items in own.values():
            for c in itertools.combinations(sorted(items), k):
                count[c] = count.get(c, 0) + 1
        good = {c: n for c, n in count.items() if n >= support}
        if not good:
            return out
        out |= good
        k += 1


@pytest.mark.parametrize("prune", ["none", "all_subsets"])
def test_apriori_matches_brute_force(spark, prune):
    rng = random.Random(3)
    rows = sorted({(rng.randint(1, 30), rng.choice("abcdefg")) for _ in range(130)})
    got = itemsets.apriori(spark.createDataFrame(rows, "basket long, item string"), 6, prune=prune)
    frequent = {tuple(r["items"]): r.n for r in got.where("kind = 'frequent'").collect()}
    assert frequent == brute(rows, 6)
    for r in got.where("kind = 'candidate' and size > 1").collect():
        if prune == "all_subsets":
            assert all(s in frequent for s in itertools.combinations(r["items"], r["size"] - 1))


def test_son_candidates_hold_every_frequent_item(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randint(1, 200), rng.randint(1, 20)) for _ in range(900)})
    df = spark.createDataFrame(rows, "basket long, item long")
    son = {r["item"] for r in itemsets.son_candidates(df, 45).collect()}
    assert {r["items"][0] for r in itemsets.frequent_items(df, 45).collect()} <= son


def test_string_baskets(spark):
    rng = random.Random(5)
    rows = sorted({(f"11/{rng.randint(1, 28)}/00-{rng.randint(1, 9)}", rng.choice("abcdefg")) for _ in range(300)})
    df = spark.createDataFrame(rows, "basket string, item string")
    got = {tuple(r["items"]): r.n for r in itemsets.apriori(df, 6).where("kind = 'frequent'").collect()}
    assert got == brute(rows, 6) and max(map(len, got)) > 1
    loose, strict = ({r["item"] for r in itemsets.son_candidates(df, 30, strict=x).collect()} for x in (False, True))
    assert strict <= loose and {r["items"][0] for r in itemsets.frequent_items(df, 30).collect()} <= loose


def test_dense_ids(spark):
    rng = random.Random(2)
    names = [f"n{rng.randint(0, 900)}" for _ in range(2000)]
    got = dense_ids(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), "name").collect()
    assert {r.name: r.id for r in got} == {n: i for i, n in enumerate(sorted(set(names)))} and len(got) == len(set(names))
    assert dense_ids(spark.createDataFrame([], "name string"), "name").collect() == []


def test_a_cluster_must_name_a_shared_folder():
    conf = lambda folder: SimpleNamespace(get=lambda key, default: folder)
    session = lambda master, folder=None: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(folder)))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert shared_dir(session("local[4]")).startswith("file:")


def test_report_lines(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c")]
    own = itemsets.report(itemsets.apriori(spark.createDataFrame(rows, "basket long, item string"), 2))
    lines = [r.value for r in writers.itemset_lines(own).collect()]
    assert lines == ["Candidates:", "('a'),('b'),('c')", "('a', 'b')", "Frequent Itemsets:", "('a'),('b')", "('a', 'b')"]


def test_top_k_and_partitions(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "user long, item long")
    assert [tuple(r) for r in stats.top_k(df, "user", 3).collect()] == [(0, 15), (1, 15), (2, 14)]
    assert sum(r.n_items for r in stats.partition_report(stats.repartitioned(df, 5, "user")).collect()) == 100


def test_readers(spark, tmp_path):
    (tmp_path / "tx.csv").write_text('"11/14/2000","00012321","x","x","x","0471","x"\n"1/2/2001","7","x","x","x","9","x"\n"d","c","x","x","x","p","x"\n')
    got = readers.transactions(spark, str(tmp_path / "tx.csv"), 7).collect()
    assert [tuple(r) for r in got][:1] in ([("1/2/01-7", 9)], [("11/14/00-12321", 471)])
    (tmp_path / "p.txt").write_text("0,3,1.5,2\n1,-1,0,4\n")
    assert [tuple(r) for r in readers.points(spark, str(tmp_path / "p.txt")).orderBy("idx").collect()] == [(0, 3, [1.5, 2.0]), (1, -1, [0.0, 4.0])]
    (tmp_path / "b.csv").write_text("user_id,business_id\n007,a\n")
    assert readers.csv(spark, str(tmp_path / "b.csv"), readers.BASKET).head().user_id == "007"
    (tmp_path / "r.json").write_text('{"review_id":"r","stars":4.0}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).head().stars == 4.0
    ids = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "pos long, user_id string")
    draws = readers.simulated_draws(ids, 10, 3).collect()
    assert len(draws) == 30 and {r.batch for r in draws} == {0, 1, 2}


def test_duckdb_agrees_on_catalog(spark):
    """The cheap queries of the catalog against their oracles on the smallest tables."""
    from tessera.plans.catalog import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation supplier part orders lineitem events documents embeddings".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("review_counts", "top10_users", "city_top10", "partition_report", "tx_baskets", "basket_case2", "bloom_fpr", "fm_estimate", "reservoir_sample", "cold_start", "error_histogram", "cluster_mahalanobis", "ds_cs_rs_assign"):
        got = QUERIES[name](spark, d)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({SQL[name]})").fetchall()
        assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(want), name


def test_csv_fields_with_quotes_and_commas_come_back(spark, tmp_path):
    rows = [("007", 'a "b", c', 1), ("8", 'x "y"', None)]
    writers.csv(spark.createDataFrame(rows, "id string, name string, n int"), str(tmp_path / "out"))
    back = readers.csv(spark, str(tmp_path / "out"), "id string, name string, n int")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_support_weighs_the_two_predictions(spark):
    pred = lambda v: spark.createDataFrame([(1, 1, v), (2, 2, v), (3, 3, v)], "user long, item long, prediction double")
    used = spark.createDataFrame([(1, 1)] * 3 + [(2, 2)], "user long, item long")
    counts = spark.createDataFrame([(1, 1)], "item long, n long")
    got = {r.user: r.prediction for r in recommend.support_hybrid(pred(4.0), pred(2.0), used, counts).collect()}
    assert abs(got[1] - (3 * 4 + math.log(2) * 2) / (3 + math.log(2))) < 1e-12 and (got[2], got[3]) == (4.0, 2.0)
