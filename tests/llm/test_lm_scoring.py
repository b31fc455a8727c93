import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_scoring as lm
from tessera.llm.common import strings


def small_net(texts):
    h, _, _ = lm.tokens(strings(pa.array(texts)))
    u, n = np.unique(h, return_counts=True)
    return lm.WindowNetwork(u[np.lexsort((u, -n))][: lm.NUMBERS - lm.SHAPES])


def test_log_probs_match_the_definition():
    texts = ["a b c d e f g", "", "a", "c c b 12 !!", "g f"]
    net = small_net(texts)
    hashes, shape, bounds = lm.tokens(strings(pa.array(texts)))
    ids = net.numbers(hashes, shape)
    got = net.log_probs(*net.padded(ids, bounds))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for d in range(len(texts)):
        for i in range(bounds[d], bounds[d + 1]):
            h = p["bias"].copy()
            for j, o in enumerate(lm.OFFSETS):
                if bounds[d] <= i + o < bounds[d + 1]:
                    h += p["embed"][ids[i + o]] * p["place"][j]
            h = np.tanh(h)
            soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
            c, w = divmod(int(ids[i]), lm.EACH)
            want = soft(p["class"] @ h + p["class_bias"])[c] + soft(p["word"][c] @ h + p["word_bias"][c])[w]
            assert abs(got[i] - want) < 1e-4


def test_gradient_step_lowers_the_loss_and_matches_differences():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(8)]
    net = small_net(texts)
    hashes, shape, bounds = lm.tokens(strings(pa.array(texts)))
    stream, at = net.padded(net.numbers(hashes, shape), bounds)
    before = net.log_probs(stream, at).mean()
    seen = {k: v.copy() for k, v in net.p.items()}
    sums = {k: np.full_like(v, 1.0) for k, v in net.p.items()}
    net.step(stream, at, sums, 1.0)
    grad = {k: (seen[k] - net.p[k]) * np.sqrt(sums[k]) for k in seen}  # what the step moved by
    assert net.log_probs(stream, at).mean() > before
    for k, where in (("embed", (int(stream[at[3]]), 2)), ("place", (1, 4)), ("class", (0, 3)), ("word", (0, int(stream[at[0]]) % lm.EACH, 1)), ("bias", (5,)), ("word_bias", (0, 1))):
        loss = []
        for e in (1e-2, -1e-2):
            net.p = {x: v.copy() for x, v in seen.items()}
            net.p[k][where] += e
            loss.append(-net.log_probs(stream, at).mean())
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[k][where]) < 2e-3


def test_rows_are_whole(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(words[(s + i) % 40] for s in [rng.randrange(40)] for i in range(60))
    rows = [(i, text()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    net = lm.fit(docs)
    good = text()
    odd = [(1, good), (2, good.upper()), (3, None), (4, " "), (1, good), (None, "w1"), (5, "w1 " * 200_000)]
    out = lm.score(spark.createDataFrame([(*r, 0) for r in odd], "doc_id long, text string, n_tokens int"), net).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7 and got[1].log_prob == got[2].log_prob < 0 and got[1].n_tokens == 60
    assert (got[3].n_tokens, got[3].log_prob, got[3].perplexity) == (0, 0.0, None) and got[5].n_tokens == 200_000
    assert lm.score(docs.limit(0), net).collect() == []
    assert lm.fit(docs.limit(0), rounds=1).flat().shape == net.flat().shape


def test_vocabulary_counts_everything(spark):
    docs = spark.createDataFrame([("a B b",), ("b",), (None,)], "text string")
    assert sorted(r.n for r in lm.vocabulary(docs).collect()) == [1, 3]


@pytest.mark.parametrize("held", [lm.HELD, 1])  # counts that travel with the network, and counts that are joined
def test_rare_words_have_their_own_probability(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    common = " ".join(f"c{i}" for i in range(lm.NUMBERS - lm.SHAPES))
    texts = [common] * 3 + ["rareword " * 2 + "oddity"]
    net = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), rounds=1)
    assert len(net.held) == (2 if held > 1 else 1)
    got = {r.text: r.log_prob for r in lm.score(spark.createDataFrame([("rareword",), ("oddity",), ("unseenword",), ("c1",)], "text string"), net).collect()}
    counts = {"rareword": 2, "oddity": 1, "unseenword": 0}
    _, shape, _ = lm.tokens(strings(pa.array(list(counts))))
    for (w, n), s in zip(counts.items(), shape, strict=True):
        h, own, bounds = lm.tokens(strings(pa.array([w])))
        head = net.log_probs(*net.padded(net.numbers(h, own), bounds))[0]
        of = [k for k, t in zip(("rareword", "oddity"), shape, strict=False) if t == s]
        mass = sum(counts[k] + lm.UNSEEN for k in of) + lm.UNSEEN
        assert abs(got[w] - head - np.log((n + lm.UNSEEN) / mass)) < 1e-6
    h, own, bounds = lm.tokens(strings(pa.array(["c1"])))
    assert abs(got["c1"] - net.log_probs(*net.padded(net.numbers(h, own), bounds))[0]) < 1e-6


def test_numbers_grow_with_the_corpus(spark):
    for each, own in ((1, 960), (2000, 1600)):  # 4,000 words, once and 2,000 times: 8 * 8e6 ** (1 / 3)
        counts = spark.range(4000).selectExpr("id as h", "0 as shape", f"{each}L as n")
        net = lm._numbered(counts)
        assert abs(len(net.known) - own) <= 1 and net.rest.count() + len(net.held) == 4000 - len(net.known)
        assert net.count >= len(net.known) + lm.SHAPES and net.numbers(net.known, np.zeros(len(net.known), int)).max() < net.count - lm.SHAPES


def test_training_masks_every_position_once(monkeypatch):
    texts = ["a b c d e f g " * 900, "", "a", "c c b 12 !!", None] * 20
    hashes, shape, bounds = lm.tokens(strings(pa.array(texts)))
    net = small_net(texts)
    stream, at = net.padded(net.numbers(hashes, shape), bounds)
    seen = []
    monkeypatch.setattr(lm.WindowNetwork, "step", lambda self, s, own, sums, rate: seen.append(own))
    monkeypatch.setattr(lm, "LARGEST", 2000)
    assert net.train(strings(pa.array(texts)), {}, 5) == 5 + len(hashes)
    assert np.array_equal(np.concatenate(seen), at) and 1 < len({*map(len, seen)})


def test_logits_that_are_not_safe_give_the_same_probabilities():
    net = small_net(["a b c d e f g"])
    hashes, shape, bounds = lm.tokens(strings(pa.array(["a b g f", "c"])))
    stream, at = net.padded(net.numbers(hashes, shape), bounds)
    near = net.log_probs(stream, at)
    assert net.safe()
    net.p["class_bias"] += 300  # softmax does not change by a constant
    assert not net.safe() and np.allclose(net.log_probs(stream, at), near, atol=1e-4)


def test_production_training_learns_order_and_predicts_held_out_text(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(words[(s + i) % 40] for s in [rng.randrange(40)] for i in range(60))
    net = lm.fit(spark.createDataFrame([(text(),) for _ in range(4000)], "text string").repartition(2))
    good = [text() for _ in range(20)]
    bad = [" ".join(rng.sample(t.split(), 60)) for t in good]
    per_word = lambda texts: np.mean([r.log_prob / r.n_tokens for r in lm.score(spark.createDataFrame([(t,) for t in texts], "text string"), net).collect()])
    assert per_word(good) > -np.log(40) + 1 and per_word(good) > per_word(bad) + 1
