"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts each word from the WINDOW words on both sides: their
embeddings, weighted by place, are summed and squashed, and a two-level softmax gives first the
word's class and then the word. A document's score is the sum of the log-probabilities of all its
words, each given both sides.

Word counts are taken over the whole corpus; the most frequent words have a number each, more of them
the larger the corpus, and the rest share numbers by shape. The network gives the shape of such a
word, the corpus counts give the word among those of its shape, by a join on the word. Training covers
every position of the whole corpus: every partition runs AdaGrad over its documents, each position
masked in turn, and the partitions' weights are averaged, in rounds that share out the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, Sent, raw, steps, stored, table, word_hashes, words

#: Classes x words of a class = numbers, at least; the last SHAPES of them are for all rarer words.
CLASSES, EACH, SHAPES = 32, 32, 64
#: Words with a number of their own: GROWTH times the cube root of the corpus's words, if that is more.
GROWTH = 8
#: Counts of about so many further words travel with the network; those of the rest are joined.
HELD = 1 << 18
#: What a word's count among those of its shape is raised by; an unseen word has this alone.
UNSEEN = 0.1
WINDOW, SIZE = 3, 16
#: Rounds of averaging; each document has its positions masked in one of them.
ROUNDS = 2
#: Words of a step: LEAST, then the words before it in this partition over GROWING, up to LARGEST.
LEAST, GROWING, LARGEST, RATE = 512, 32, 8192, 0.2
NUMBERS = CLASSES * EACH
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
#: Weight vectors travel in this many parts, and at most FAN of them meet in one sum.
PARTS, FAN = 8, 64


def tokens(texts: pa.Array):
    """Hashes of the lower-cased words, a shape of each in 0..SHAPES-1, which also is the hash modulo
    SHAPES, and n_texts+1 bounds."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, _, bounds = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    count = lambda m: (lambda t: t[ends] - t[starts])(np.concatenate([[0], np.cumsum(m)]))
    length, letters, digits = ends - starts, count(letter), count(digit)
    other = (length - letters - digits) > (length > 3)  # one mark at a word's end is usual
    shape = np.minimum(3, length // 5) * 16 + other * 8 + (digits > 0) * 4 + (hashes & U64(3)).astype(np.int64)
    return hashes & ~U64(SHAPES - 1) | shape.astype(U64), shape, bounds


class WindowNetwork:
    """The network's weights; ``vocabulary`` has the hashes of the frequent words, most frequent first.

    ``held`` has the hashes of the next words in ascending order and ``held_n`` their counts, ``rest``
    is the table (h, n) of all other words of the corpus, and ``mass`` has, by shape, the counts of held
    and other words together, each raised by UNSEEN, and that of one unseen word.
    """

    def __init__(self, vocabulary: np.ndarray):
        self.held, self.held_n, self.mass = np.zeros(0, U64), np.zeros(0, np.int64), np.full(SHAPES, UNSEEN)
        self.rest: DataFrame | None = None
        self.classes = self.each = max(CLASSES, math.isqrt(len(vocabulary) + SHAPES - 1) + 1)
        self.count = self.classes * self.each
        order = np.argsort(vocabulary, kind="stable")
        self.known, self.rank = vocabulary[order], order.astype(np.int32)
        rng = np.random.default_rng(1)
        init = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "embed": init(self.count + 1, SIZE), "place": np.ones((2 * WINDOW, SIZE), np.float32) / WINDOW, "bias": np.zeros(SIZE, np.float32),
            "class": init(self.classes, SIZE), "class_bias": np.zeros(self.classes, np.float32), "word": init(self.classes, self.each, SIZE), "word_bias": np.zeros((self.classes, self.each), np.float32),
        }
        self.p["embed"][self.count] = 0  # outside the document

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def numbers(self, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = (self.count - SHAPES + shape).astype(np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[at] == hashes
            out[hit] = self.rank[at[hit]]
        return out

    def padded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers with WINDOW blanks between documents, and the place of each word in them."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.arange(len(ids)) + WINDOW * (doc + 1)
        out = np.full(len(ids) + WINDOW * len(bounds), self.count, np.int32)
        out[at] = ids
        return out, at

    def near(self, stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers around the ascending places, their embeddings, and each place's hidden layer."""
        low, n = at[0], at[-1] + 1 - at[0]
        ids = stream[low - WINDOW : low + n + WINDOW]
        e = self.p["embed"][ids]
        h = np.broadcast_to(self.p["bias"], (n, SIZE)).copy()
        part = np.empty_like(h)
        for j, o in enumerate(OFFSETS):
            h += np.multiply(e[WINDOW + o : WINDOW + o + n], self.p["place"][j], out=part)
        h = h[at - low]
        return ids, e, np.tanh(h, out=h)

    def counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The held counts of words, 0 for others, and which are held."""
        if not len(self.held):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.held, hashes), len(self.held) - 1)
        hit = self.held[at] == hashes
        return np.where(hit, self.held_n[at], 0), hit

    def safe(self) -> bool:
        """Whether no logit can be so large that its exponential leaves the range of numbers."""
        return max(float(np.abs(self.p[k]).sum(axis=-1).max() + np.abs(self.p[k + "_bias"]).max()) for k in ("class", "word")) < 60

    def sorted_by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An order of words by class, class and word in it of each in that order, and the classes' bounds."""
        cls = (ids // self.each).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        return order, cls[order], (ids[order] % self.each), np.searchsorted(cls[order], np.arange(self.classes + 1))

    def log_probs(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of each word at the given ascending places, given both sides."""
        out, safe = np.empty(len(at), np.float64), self.safe()
        for i in range(0, len(at), LARGEST):
            own = at[i : i + LARGEST]
            h = self.near(stream, own)[2]
            order, cls, word, cut = self.sorted_by_class(stream[own])
            h = h[order]
            rows = np.arange(len(own))
            z = h @ self.p["class"].T
            z += self.p["class_bias"]
            lp = z[rows, cls]
            lp -= _log_sum(z, safe)
            for c in range(self.classes):
                a, b = cut[c], cut[c + 1]
                if a < b:
                    z = h[a:b] @ self.p["word"][c].T
                    z += self.p["word_bias"][c]
                    lp[a:b] += z[rows[: b - a], word[a:b]]
                    lp[a:b] -= _log_sum(z, safe)
            out[i + order] = lp
        return out

    def step(self, stream: np.ndarray, at: np.ndarray, sums: dict[str, np.ndarray], rate: float) -> None:
        """One AdaGrad step on the words at the given ascending places."""
        p, n, safe = self.p, np.float32(len(at)), self.safe()

        def descend(g: np.ndarray, key: str, where=...) -> None:
            g = g / n
            sums[key][where] += g * g
            p[key][where] -= rate * g / np.sqrt(sums[key][where])  # where nothing is said, the gradient is 0

        ids, e, h = self.near(stream, at)
        order, cls, word, cut = self.sorted_by_class(stream[at])
        h = h[order]
        z = _softmax(h @ p["class"].T + p["class_bias"], safe)
        z[np.arange(len(at)), cls] -= 1
        dh = z @ p["class"]
        descend(z.T @ h, "class")
        descend(z.sum(axis=0), "class_bias")
        for c in range(self.classes):
            a, b = cut[c], cut[c + 1]
            if a < b:
                z = _softmax(h[a:b] @ p["word"][c].T + p["word_bias"][c], safe)
                z[np.arange(b - a), word[a:b]] -= 1
                dh[a:b] += z @ p["word"][c]
                descend(z.T @ h[a:b], "word", c)
                descend(z.sum(axis=0), "word_bias", c)
        dh *= 1 - h * h
        m = len(e) - 2 * WINDOW
        d = np.zeros((m, SIZE), np.float32)
        d[at[order] - at[0]] = dh
        de, place = np.zeros_like(e), np.empty_like(p["place"])
        for j, o in enumerate(OFFSETS):
            de[WINDOW + o : WINDOW + o + m] += d * p["place"][j]
            place[j] = np.einsum("ij,ij->j", d, e[WINDOW + o : WINDOW + o + m])
        order = np.argsort(ids.astype(np.uint16) if self.count < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        g = np.add.reduceat(de[order], heads, axis=0)
        g[ids[heads] == self.count] = 0
        descend(g, "embed", ids[heads])
        descend(place, "place")
        descend(d.sum(axis=0), "bias")

    def train(self, texts: pa.Array, sums: dict[str, np.ndarray], done: int = 0) -> int:
        """Steps over every word of the texts; ``done`` words went before. How many there are now."""
        hashes, shape, bounds = tokens(texts)
        stream, at = self.padded(self.numbers(hashes, shape), bounds)
        i = 0
        while i < len(at):
            size = min(LARGEST, max(LEAST, (done + i) // GROWING))
            self.step(stream, at[i : i + size], sums, RATE)
            i += size
        return done + len(at)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def copy(self) -> WindowNetwork:
        out = copy(self)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].astype(np.float32).reshape(self.p[k].shape)
            at += n
        return self


def _softmax(z: np.ndarray, safe: bool) -> np.ndarray:
    """In place; only where logits may be ``safe`` no maximum is taken off first."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_sum(z: np.ndarray, safe: bool) -> np.ndarray:
    """Logarithm of the sum of the exponentials of each row, which takes the place of ``z``."""
    if safe:
        return np.log(np.exp(z, out=z).sum(axis=1))
    top = z.max(axis=1)
    z -= top[:, None]
    return top + np.log(np.exp(z, out=z).sum(axis=1))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, shape, n): every distinct word of the corpus by its hash, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in steps(batch, "text", 8 << 20):
                h, n = np.unique(tokens(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.select("h", F.pmod("h", F.lit(SHAPES)).cast("int").alias("shape"), "n")


def _numbered(counts: DataFrame) -> WindowNetwork:
    """A network without training for the words of ``counts``."""
    total = counts.agg(F.sum("n")).head()[0] or 0
    own = max(NUMBERS - SHAPES, int(GROWTH * total ** (1 / 3)))
    least, words_ = 1 << 62, 0  # words that occur as often as that are collected; words of equal count go together
    for n, k in sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True):
        words_ += k
        if words_ > own + HELD:
            break
        least = n
    top = counts.where(F.col("n") >= least).select("h", "shape", "n").toArrow()
    h, shape, n = (np.asarray(top.column(c).to_numpy()) for c in ("h", "shape", "n"))
    order = np.lexsort((h, -n))
    net = WindowNetwork(h[order[:own]].view(U64))
    order = order[own:]
    np.add.at(net.mass, shape[order], n[order] + UNSEEN)
    order = order[np.argsort(h[order].view(U64), kind="stable")]
    net.held, net.held_n = h[order].view(U64), n[order]
    net.rest = counts.where(F.col("n") < least).select("h", "n")
    for r in counts.where(F.col("n") < least).groupBy("shape").agg((F.sum("n") + UNSEEN * F.count("*")).alias("mass")).collect():
        net.mass[r["shape"]] += r["mass"]
    return net


def _train(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, done = sent.value.copy(), 0
        sums = {k: np.full_like(v, 1e-4) for k, v in model.p.items()}
        for batch in batches:
            for _, texts in steps(batch, "text"):
                done = model.train(texts, sums, done)
        if done:
            flat = np.array_split(model.flat() * np.float64(done), PARTS)
            context = TaskContext.get()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), pa.array(np.full(PARTS, context.partitionId() if context else 0)), pa.array(np.full(PARTS, float(done))), pa.array([x.tolist() for x in flat], pa.list_(pa.float64()))], ["part", "pid", "weight", "v"])

    return run


def _sum(t: pa.Table) -> pa.Table:
    v = np.sum([np.asarray(x.values) for x in t.column("v")], axis=0)
    return pa.table({"part": t.column("part")[:1], "pid": t.column("pid")[:1], "weight": pa.array([float(np.sum(t.column("weight").to_numpy()))]), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})


def fit(docs: DataFrame, rounds: int = ROUNDS) -> WindowNetwork:
    """Train on all of ``docs`` (text): each document is in one of the rounds, by the hash of its text,
    and there each of its positions is masked once. The driver receives the frequent words and one
    sum of weights a round. Without words the initial weights remain. How the rows are dealt to
    partitions and their order have a part in the weights, as each partition steps on its own.
    Null and empty texts teach nothing; repeated rows count each."""
    spark = docs.sparkSession
    counts = stored(vocabulary(docs), "words")
    net = _numbered(counts)
    schema = "part long, pid long, weight double, v array<double>"
    for r in range(rounds):
        own = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
        own = own.mapInArrow(_train(Sent(spark, net)), schema)
        left = docs.rdd.getNumPartitions()
        while True:  # sums of FAN at a time
            own = own.withColumn("pid", F.floor(F.col("pid") / FAN).cast("long")).groupBy("part", "pid").applyInArrow(_sum, schema)
            left = -(-left // FAN)
            if left <= 1:
                break
        rows = sorted(own.collect(), key=lambda x: x.part)
        if rows:
            net = net.load(np.concatenate([np.array(x.v) / x.weight for x in rows]))
    return net


def score(docs: DataFrame, net: WindowNetwork) -> DataFrame:
    """``docs`` (text, any columns) with ``n_tokens``, ``log_prob`` (sum over all words) and
    ``perplexity``.

    A word without a number of its own has the log-probability of its shape and of the word in that:
    its count plus UNSEEN, of ``net.mass``. Counts that the network does not hold are joined.

    Null and blank texts have no tokens: log_prob 0, perplexity null. Columns of these names are
    replaced; repeated rows get equal results, an empty table gives an empty result. The network runs
    row by row over whole texts.
    """
    sent = Sent(docs.sparkSession, net)
    docs = docs.drop("n_tokens", "log_prob", "perplexity")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in steps(batch, "text"):
                hashes, shape, bounds = tokens(texts)
                ids = net.numbers(hashes, shape)
                lp = net.log_probs(*net.padded(ids, bounds))
                rare = np.flatnonzero(ids >= net.count - SHAPES)
                n, held = net.counts(hashes[rare])
                lp[rare] += np.log(n + UNSEEN) - np.log(net.mass)[shape[rare]]
                rare = rare[~held]
                lp = np.concatenate([[0.0], np.cumsum(lp)])
                ends = np.searchsorted(rare, bounds)
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[rare].view(np.int64)))
                own = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(lp[bounds[1:]] - lp[bounds[:-1]]), pa.array(row + np.arange(part.num_rows)), rest]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *own], [*names, "n_tokens", "log_prob", "_row", "_rest"])

    own = T.StructType.fromDDL("n_tokens long, log_prob double, _row long, _rest array<long>")
    out = stored(docs.mapInArrow(run, T.StructType(docs.schema.fields + own.fields)), "scored")
    if net.rest is not None:
        seen = F.log(F.col("n") + UNSEEN) - math.log(UNSEEN)
        rest = out.select("_row", F.explode("_rest").alias("h")).join(net.rest, "h")
        rest = rest.groupBy("_row").agg(F.sum(seen).alias("_seen"))
        out = out.drop("_rest").join(rest, "_row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("_seen", F.lit(0.0)))
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens")))
    return out.select(*names, "n_tokens", "log_prob", perplexity.alias("perplexity"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs))
