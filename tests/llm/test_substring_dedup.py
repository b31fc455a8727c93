import random

import pytest

from tessera.llm import substring_dedup as sd
from tessera.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, n):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1 if i is not None else 0):
            g = tuple(w[k : k + n])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1 if i is not None else 0):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def got(spark, rows, n, **kw):
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA), n, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode()) for r in out), key=str)


@pytest.mark.parametrize(("n", "k"), [(13, 7), (13, 3), (5, 3), (4, 2)])
def test_random_repeats_match_brute_force(spark, n, k):
    rng = random.Random(n * k)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(n - 2, 3 * n))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice("xyz") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 90), rng.choice([" ", "\n", "\t "]).join(parts)))
    assert got(spark, rows, n, block_words=k) == brute(rows, n)


def test_a_passage_in_very_many_documents(spark):
    hot = " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"{hot} own{i}") for i in range(3000)]
    out = got(spark, rows, 13)
    assert sum(r[2] == 0 for r in out) == 1 and sum(r[2] == 20 for r in out) == 2999


def test_more_tasks_than_the_session_has_partitions(spark, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(f"{c}{rng.randint(0, 9)}" for _ in range(20)) for c in "abcd"]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.3 else f"own{i}x{j}" for j in range(30))) for i in range(200)]
    want = brute(rows, 13)
    for name, size in (("CHUNK_BYTES", 2000), ("BUCKET_BYTES", 3000), ("TASK_BYTES", 4000)):
        monkeypatch.setattr(sd, name, size)
    assert got(spark, rows, 13) == want
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA), 13)
    assert out.rdd.getNumPartitions() > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nulls_blanks_and_the_text_that_is_left(spark):
    a = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"start {a} end"), (2, f"  one\n{a}\n\ttwo  three\n"), (None, a), (3, None), (4, ""), (5, " \n"), (6, "é ß")]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), 13).collect()}
    assert out[2].text == "  one\ntwo  three\n" and [(s.start, s.end) for s in out[2].removed] == [(1, 14)]
    assert out[1].text == rows[0][1] and out[None].text == a and out[3].text is None and out[5].text == " \n"
    assert (out[6].n_words, out[3].n_words, out[2].n_removed) == (1, 0, 13)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y", "s", 7)], "doc_id long, text string, source string, n_words int")
    r = substring_dedup(df, 13).head()
    assert (r.source, r.n_words) == ("s", 2)
    assert substring_dedup(spark.createDataFrame([], SCHEMA), 13).collect() == []
    with pytest.raises(ValueError, match="whole block"):
        substring_dedup(df, 13, 8)
