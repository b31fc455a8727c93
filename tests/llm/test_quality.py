import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality as q
from tessera.llm.common import raw, strings


def test_linear_time_identity_matches_pairs():
    rng = np.random.default_rng(0)
    fm = q.FactorisationMachine(width=50, factors=3)
    fm.w = rng.normal(size=50).astype(np.float32)
    number, value = np.array([1, 7, 9, 3, 7]), rng.normal(size=5).astype(np.float32)
    want = []
    for a, b in ((0, 3), (3, 5)):
        n, x = number[a:b], value[a:b]
        want.append(fm.w[n] @ x + sum(fm.v[n[i]] @ fm.v[n[j]] * x[i] * x[j] for i in range(len(n)) for j in range(i)))
    assert np.allclose(fm.margin(number, value, np.array([0, 3, 5])), want, atol=1e-4)


def test_features_do_not_depend_on_the_batch():
    texts = ["", "A B b!! c", "x | y |\nx | y |", "é " * 400, "one", " \n"]
    data = strings(pa.array(texts))
    number, value, bounds = q.features(*raw(data), [None, 3, 0, 10**6, -4, 1])
    for i, t in enumerate(texts):
        n, v, b = q.features(*raw(strings(pa.array([t]))), [[None, 3, 0, 10**6, -4, 1][i]])
        own = slice(bounds[i], bounds[i + 1])
        assert sorted(zip(n, v, strict=True)) == sorted(zip(number[own], value[own], strict=True)) and b.tolist() == [0, len(n)]


def test_held_out_accuracy_and_all_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = q.op6_quality(spark, d)
    assert out.count() == docs.count()
    got = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.97
    assert sum(r.predicted for r in got if r.quality) / sum(r.quality for r in got) > 0.99


def test_held_out_labels_are_no_input(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    crc = F.crc32(F.col("doc_id").cast("string")) % 5
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(crc == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    one, other = ({r.doc_id: r for r in q.op6_quality(spark, x).collect()} for x in (d, str(tmp_path)))
    assert one == other and len({r.score for r in one.values()}) > 100
    assert {r.doc_id for r in one.values() if r.held_out} == {r.doc_id for r in docs.where(crc == 0).collect()}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = [(1, "good text here", 14, "a"), (2, "BAD!! TEXT!!", 12, "b"), (3, None, None, None), (None, "", 0, "c"), (1, "good text here", 14, "a"), (4, "w " * 200_000, 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    model = q.fit(docs.drop("score"), labels)
    out = q.score_quality(docs, model).collect()
    assert len(out) == 6 and all(0 < r.score < 1 and r.predicted == int(r.score >= 0.3) for r in out)
    none = q.fit(docs, labels.limit(0))
    assert len(q.score_quality(docs, none).collect()) == 6
    assert q.score_quality(docs.limit(0), model).collect() == []
