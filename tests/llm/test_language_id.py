import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import language_id as li


def brute(text: bytes, train: bytes) -> int:
    """Greedy phrases of the whole text."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_match_brute_force():
    rng = random.Random(3)
    train = {k: bytes(rng.choice(b"abc d\xc3\xa9") for _ in range(400)) for k in ("x", "y")}
    model = li.LanguageModel(train)
    texts = ["".join(rng.choice("abcd eé!z") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 900, 3, 5000, 512)]
    texts += [train["x"].decode(errors="ignore") * 8, "a" * 2000, "".join(rng.choice("abc ") for _ in range(3000))]
    data, offsets = li.coded(pa.array(texts, pa.large_string()))
    got = model.phrases(data, offsets)
    for i in range(len(texts)):
        own = data[offsets[i] : offsets[i + 1]].tobytes()
        assert [brute(own, train[k]) for k in ("x", "y")] == got[i].tolist()


def test_predictions_on_odd_rows(spark):
    train = [(i, "the cat sat on the mat and then it was there again", "en") for i in range(20)] + [(i + 20, "der hund und die katze sind nicht im haus gewesen", "de") for i in range(20)]
    train += [(99, None, "en"), (98, "text", None), (None, "x", "fr")]
    model = li.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    rows = [(1, "then the cat was there", 1), (2, "die katze und der hund", 2), (3, None, 3), (4, "", 4), (5, "12 %% !!", 5), (6, "“” —", 6), (1, "then the cat was there", 1), (7, "the cat " * 60_000, 7), (8, "жук", 8)]
    out = li.identify(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == 9 and got[1][0] == "en" and got[2][0] == "de" and got[7][0] == "en" and got[8][0] in ("de", "en")
    assert got[3] == got[4] == got[5] == got[6] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.text for r in out if r.doc_id == 3} == {None}
    none = li.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, n int"), none).collect()} == {"und"}


def test_held_out_languages_are_no_input(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string")) % 4
    docs.withColumn("lang", F.when(crc == 2, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    one, other = ({r.doc_id: r for r in li.op9_language(spark, x).collect()} for x in (d, str(tmp_path)))
    assert one == other
    assert {r.doc_id for r in one.values() if r.held_out} == {r.doc_id for r in docs.where(crc == 2).collect()}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = li.op9_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
