import random

import corpus_pipeline as cp
from tessera.llm.decontamination import decontaminate
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_substring_dedup import brute as cut_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, tmp_path):
    rng = random.Random(8)
    en, de = "the of and to in was that with from this".split(), "der die und das nicht ein mit von sich auf".split()
    word = lambda own, ends: rng.choice(own) if rng.random() < 0.4 else "".join(rng.choice(ends) for _ in range(3))
    say = lambda k, n: " ".join(word(en, ["th", "er", "ing", "on", "ly"]) if k == "en" else word(de, ["ung", "sch", "keit", "ei", "ber"]) for _ in range(n))
    passage, item = say("en", 70), say("en", 30)
    rows = []
    for i in range(140):
        k = "de" if i % 3 == 0 else "en"
        text = say(k, rng.randint(40, 160))
        if i % 20 == 4:
            text += " " + passage + " " + say(k, 30)
        if i % 25 == 7:
            text += " " + item
        rows.append((i, text, k, f"src{0 if i % 2 else i % 5}", len(text)))
    copies = [(200 + i, rows[i][1], "en", "copies", rows[i][4]) for i in range(0, 30, 3)]
    edits = [(300 + i, rows[i][1] + " one more", rows[i][2], "copies", 0) for i in range(1, 30, 3)]
    junk = [(400, None, "en", "x", None), (401, "", "en", "x", 0), (402, "12 %% 34", "en", None, 8), (None, say("en", 50), None, None, 1)]
    docs = spark.createDataFrame(rows + copies + edits + junk, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    docs, d = fixture(spark, tmp_path)
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    before = docs.collect()
    first = cp.language_id(spark, docs, d)
    kept = first.collect()
    assert {r.doc_id for r in before} - {r.doc_id for r in kept} == {400, 401, 402}
    told = {o.doc_id: o.lang for o in before if o.doc_id is not None and o.doc_id < 140 and o.doc_id % 20 != 4 and o.doc_id % 25 != 7}
    assert all(r.lang == told[r.doc_id] for r in kept if r.doc_id in told)  # of one language all through

    second = cp.near_dedup(spark, first, d)
    rows = [(r.doc_id, r.text) for r in kept]
    want = {x[0] for x in near_brute(rows, 5) if x[3]}
    assert {r.doc_id for r in second.collect()} == want and not want & set(range(200, 400))

    third = cp.cut_passages(spark, second, d)
    rows = [(r.doc_id, r.text) for r in second.collect()]
    want = {x[0]: x[3] for x in cut_brute(rows, 50)}
    got = third.collect()
    assert {r.doc_id: " ".join(r.text.split()) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert any(len(t.split()) < 150 for t in want.values()) and len(got) == len(rows)

    fourth = cp.decontamination(spark, third, d)
    bad = {r.doc_id for r in got} - {r.doc_id for r in fourth.collect()}
    assert bad == {i for i in range(140) if i % 25 == 7}
    assert bad == {r.doc_id for r in decontaminate(third, spark.read.parquet(d + "/benchmark.parquet")).where("contaminated").collect()}
    for df in (first, second, third, fourth):
        assert df.columns == cp.COLUMNS

    whole = cp.run(spark, d).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in cp.mixing(spark, fourth, d).collect()}
    assert {r.doc_id for r in whole} <= {r.doc_id for r in fourth.collect()} and cp.ORACLE_SQL is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_leave_one(spark, tmp_path):
    rows = [(1, "same words in this row and more", "en", "a", 1)] * 3 + [(2, "other words", "en", "a", 1)]
    out = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in out) == [1, 2]


def test_no_text_goes_for_another_of_its_doc_id(spark, tmp_path):
    a, b, c = ("one two three four five six seven", "red green blue black white pink grey", "north south east west up down left")
    rows = [(4, a), (6, a), (6, b), (6, c), (2, c), (6, b), (None, a), (None, a)]
    out = cp.near_dedup(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA), "")
    assert out.columns == cp.COLUMNS
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect())) == [(0, a), (0, a), (2, c), (4, a), (6, b)]
