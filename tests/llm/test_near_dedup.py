import random

import numpy as np
import pyarrow as pa

from tessera.llm.common import raw, strings
from tessera.llm.near_dedup import band_keys, near_duplicates, shingles, sketch

SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sets_of(text, n):
    w = lower(text).encode().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    own = [(i, sets_of(t, n)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            x = len(a & b)
            if a and b and 100 * x >= percent * (len(a) + len(b) - x):
                p, q = sorted((root(i), root(j)))
                at[q] = p
    out = []
    for i, t in rows:
        s = len(sets_of(t, n))
        c = i if i is None or not s else root(i)
        out.append((i, s, c, i is None or i == c))
    return sorted(out, key=str)


def got(spark, rows, n, **kw):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), n, **kw).collect()
    return sorted((tuple(r) for r in out), key=str)


def edited(words, rate, rng, vocabulary):
    out = []
    for w in words:
        x = rng.random()
        if x < rate * 0.6:
            out.append(rng.choice(vocabulary))
        elif x < rate * 0.8:
            pass
        elif x < rate:
            out += [w, rng.choice(vocabulary)]
        else:
            out.append(w)
    return out


def test_groups_of_edited_copies_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for size, rates in ((60, (0.0, 0.02, 0.05, 0.08, 0.12)), (25, (0.03, 0.06)), (12, (0.1, 0.2)), (3, (0.3,))):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        chain = base
        for _ in range(size):
            src = chain if rng.random() < 0.3 else base
            new = edited(src, rng.choice(rates), rng, vocabulary)
            chain = new if rng.random() < 0.2 else chain
            rows.append((i := i + 1, " ".join(new) + (" the common last line of many" if rng.random() < 0.3 else "")))
    rows += [(i + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for k in range(1, 60)]
    rng.shuffle(rows)
    assert got(spark, rows, 2) == brute(rows, 2)


def test_nulls_empty_ties_repeats(spark):
    a = "One two three four five six seven eight nine ten eleven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, a), (5, a.upper()), (6, a), (6, a), (None, a), (7, "word"), (8, "WORD"), (9, "É word"), (10, "é word"), (11, "word word")]
    assert got(spark, rows, 2) == brute(rows, 2)
    assert got(spark, rows, 5) == brute(rows, 5)


def test_a_document_with_several_texts_is_one_node(spark):
    a, b, c = ("one two three four five six", "red green blue black white pink", "north south east west up down")
    rows = [(4, a), (6, a), (6, b), (5, b), (7, c), (6, c), (8, "else " + a), (9, "nothing like it at all")]
    assert got(spark, rows, 2) == brute(rows, 2)
    assert {x[2] for x in got(spark, rows, 2)} == {4, 9}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a b c", 9, "x"), (2, "a b c", 8, "y")], "doc_id long, text string, component_id long, kept string")
    assert sorted(tuple(r) for r in near_duplicates(df, 2).collect()) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_long_text(spark):
    rng = random.Random(1)
    long = " ".join(str(rng.random()) for _ in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, "short text here")]
    assert got(spark, rows, 2) == [(1, 119_999, 1, True), (2, 120_000, 1, False), (3, 2, 3, True)]


def test_sketch_fills_and_estimates():
    rng = random.Random(2)
    for n in (1, 2, 7, 40, 500):
        a = [str(rng.random()) for _ in range(n)]
        b = a[: n * 9 // 10] + [str(rng.random()) for _ in range(n - n * 9 // 10)]
        grams, bounds = shingles(*raw(strings(pa.array([" ".join(a), " ".join(b), ""]))), 1)
        s = sketch(grams, bounds, 200)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        assert (s[:2] != full).all() and (s[2] == full).all()
        x, y = set(a), set(b)
        assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.13
        assert band_keys(s, 40, 5).shape == (3, 40)


def test_a_large_group_of_near_copies_needs_few_comparisons(spark, monkeypatch):
    """Copies on both sides of the threshold: links as by brute force, far fewer pairs than all."""
    from tessera.llm import near_dedup

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    n, texts = 1500, []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 5, 8, 10, 12, 14, 18))):
            words[at] = f"{i}x{at}"
        texts.append(words + ["the", "last", "line", "of", "them"] * (rng.random() < 0.4))
    sets = [{*zip(w, w[1:], strict=False)} for w in texts]
    number: dict = {}
    grid = np.zeros((n, sum(map(len, sets))), np.float32)
    for i, s in enumerate(sets):
        grid[i, [number.setdefault(x, len(number)) for x in s]] = 1
    grid = grid[:, : len(number)]
    size, shared = grid.sum(1), grid @ grid.T
    near = 100 * shared >= 80 * (size[:, None] + size[None] - shared)
    root = np.arange(n)
    while (new := np.where(near, root[None], n).min(1)).tolist() != root.tolist():
        root = new
    asked = []
    rest = near_dedup._rest
    monkeypatch.setattr(near_dedup, "_rest", lambda *a: (lambda df: asked.append(df.count()) or df)(rest(*a)))
    out = got(spark, [(i, " ".join(w)) for i, w in enumerate(texts)], 2)
    assert sorted((x[0], x[2]) for x in out) == [(i, int(r)) for i, r in enumerate(root)]
    assert 100 < len(set(root)) and asked[0] < 10 * n


def test_hot_keys_are_dealt_over_cells(spark, monkeypatch):
    """With cells of two rows every bucket, leader, hub, component and class of copies is dealt."""
    from tessera.llm import components as module

    monkeypatch.setattr(module, "CELL", 2)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(i, " ".join(edited(base, 0.03, rng, vocabulary))) for i in range(40)]
    rows += [(100 + i, " ".join(base)) for i in range(12)] + [(None, " ".join(base)), (200, "alone in the world of words"), (201, None)]
    assert got(spark, rows, 2) == brute(rows, 2)


def test_components_of_hubs_and_paths(spark, monkeypatch):
    from tessera.llm import components as module

    monkeypatch.setattr(module, "CELL", 2)
    edges = [(7, i) for i in range(20, 60)] + [(i, i + 1) for i in range(100, 120)] + [(59, 100), (300, 301), (5, 5), (None, 3)]
    made = {r.node: r.component for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {i: 7 for i in [7, *range(20, 60), *range(100, 121)]} | {300: 300, 301: 300}
    assert module.hot_keys(spark.createDataFrame([(1,)], "a long"), "a") is None
