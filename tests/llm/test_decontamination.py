import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination as dc


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment_matches_the_textbook():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        assert dc.align(np.array(a), np.array(b))[0] == smith_waterman(a, b)


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_edited_copies_are_caught_and_clean_ones_left(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "a"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else w for w in words(rng, n)]
    items = [prose(rng.randint(20, 45)) for _ in range(12)]
    rows, leaks = [], {}
    for i in range(120):
        body = prose(rng.randint(0, 300))
        if i % 3 == 0:
            k = rng.randrange(12)
            out = []
            for w in items[k]:
                x = rng.random()
                out += [] if x < 0.05 else [rng.choice(words(rng, 1))] if x < 0.15 else [w, "extra"] if x < 0.2 else [w.upper() + ","]
            at = rng.randint(0, len(body))
            body[at:at] = out
            leaks[i] = k
        rows.append((i, " ".join(body)))
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (dc.BLOCK_BYTES, 600):  # one block, and several
        got = dc.decontaminate(docs, bench, block_bytes=block).collect()
        assert {r.doc_id: r.item_id for r in got if r.contaminated} == leaks and len(got) == 120


def test_every_leaked_item_is_listed(spark):
    rng = random.Random(6)
    items = [words(rng, 25) for _ in range(6)]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)], "item_id long, text string")
    pad = [words(rng, 10) for _ in range(4)]
    text = " ".join(pad[0] + items[4][:15] + pad[1] + items[1] + pad[2] + items[3] + pad[3])
    docs = spark.createDataFrame([(1, text), (2, " ".join(pad[0])), (3, None), (4, " ".join(items[2][:5]))], "doc_id long, text string")
    for block in (dc.BLOCK_BYTES, 300):
        got = {r.doc_id: r for r in dc.decontaminate(docs, bench, block_bytes=block).collect()}
        assert [(x.item_id, round(x.score, 6), x.span_start, x.span_end) for x in got[1].leaked] == [(1, 1.0, 35, 60), (3, 1.0, 70, 95), (4, 0.6, 10, 25)]
        assert (got[1].item_id, got[1].score, got[1].span_start) == (1, 1.0, 35)
        assert got[2].leaked == got[3].leaked == got[4].leaked == []


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "alpha beta gamma"), (3, "!!"), (4, "solo"), (5, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "x ALPHA, beta gamma delta epsilon zeta", 3.0), (None, "alpha beta gamma delta epsilon zeta", 4.0), (3, "x ALPHA, beta gamma delta epsilon zeta", 3.0), (6, "a solo word", 0.0), (7, "b " * 100_000 + "alpha beta gamma delta epsilon zeta", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = dc.decontaminate(docs, bench).collect()
    got = {r.doc_id: (r.item_id, r.score, r.contaminated) for r in out}
    assert len(out) == 7 and got[1] == got[2] == (None, 0.0, False)
    assert got[3] == got[None] == got[7] == (1, 1.0, True) and got[6] == (4, 1.0, True)
    assert [(r.span_start, r.span_end) for r in out if r.doc_id == 3][0] == (1, 7)
    assert not any(r.contaminated for r in dc.decontaminate(docs, bench.limit(0)).collect())
    assert dc.decontaminate(docs.limit(0), bench).collect() == []


def test_word_counts_cover_all_rows(spark):
    docs = spark.createDataFrame([(f"Apple pear apple {i % 3}",) for i in range(500)], "text string").repartition(7)
    h, _ = dc.tokens(pa.array(["apple", "pear", "none"], pa.large_string()))
    counts, total = dc.word_counts(docs, np.sort(h))
    own = dict(zip(np.sort(h).tolist(), counts.tolist(), strict=True))
    assert [own[x] for x in h.tolist()] == [1000, 500, 0] and total == 2000


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01"])
def test_benchmark_passages_in_the_tables(spark, d):
    docs, bench = spark.read.parquet(f"{d}/documents.parquet").collect(), spark.read.parquet(f"{d}/benchmark.parquet").collect()
    flat = [" ".join(b.text.split()) for b in bench]
    want = {r.doc_id for r in docs if any(b in " ".join(r.text.split()) for b in flat)}
    got = {r.doc_id for r in dc.op5_decontamination(spark, d).where("contaminated").collect()}
    assert want and want == got
