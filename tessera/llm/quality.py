"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its hashed words (L2-normalised log counts), bins of structure
statistics (shares of capitals, digits, symbols, repeated and distinct words, line and word
lengths) and a bin of its length as the table has it. Pairwise interactions have rank ``FACTORS`` and
are summed in linear time: half of (sum of v x) squared less the sum of (v x) squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, Sent, crc_mod, raw, steps, table, word_hashes, words

#: Word buckets, rank of the interactions, and the labelled rows that training takes at most.
BUCKETS, FACTORS, TRAIN_ROWS = 1 << 15, 8, 6000
BINS = 12
STATS = ("upper", "digit", "bang", "bar", "symbol", "comma", "same", "distinct", "word", "line", "words", "repeat_line")
WIDTH = BUCKETS + (len(STATS) + 1) * BINS

_KIND = np.zeros((6, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, 48:58] = True
_KIND[2, ord("!")] = True
_KIND[3, ord("|")] = True
_KIND[4, [*b"#$%&*@^~<>{}[]\\=_+"]] = True
_KIND[5, [*b",;:"]] = True


def features(data: np.ndarray, offsets: np.ndarray, n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of each text, with n_texts+1 bounds."""
    n = len(offsets) - 1
    starts, ends, doc, bounds = words(data, offsets)
    size = np.maximum(1, np.diff(offsets))
    count = np.maximum(1, np.diff(bounds))
    low = word_hashes(LOWER[data], starts, ends)

    def per_doc(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    stats = [per_doc(k[data], offsets) / size for k in _KIND]
    same = np.zeros(len(low), bool)
    same[1:] = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1])
    stats.append(per_doc(same, bounds) / count)
    # hashed words: one entry for each document and bucket
    key = doc * BUCKETS + (low % U64(BUCKETS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    owner, bucket = key // BUCKETS, key % BUCKETS
    stats.append(np.bincount(owner, minlength=n) / count)
    stats.append(np.minimum(1, np.bincount(doc, ends - starts, n) / count / 24))
    newline = per_doc(data == 10, offsets) + 1
    stats.append(np.minimum(1, size / newline / 1024))
    stats.append(np.minimum(1, np.log2(count) / 16))
    first = np.zeros(len(low), bool)  # words that open a line, for repeated lines
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    if len(starts):
        at_line = lines[starts]
        first[0] = True
        first[1:] = (at_line[1:] != at_line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    opening = np.unique(np.stack([doc[at], low[at].view(np.int64)]), axis=1)[0] if len(at) else at
    stats.append(1 - np.bincount(opening, minlength=n) / np.maximum(1, np.bincount(doc[at], minlength=n)))
    bins = [np.minimum(BINS - 1, np.ceil(np.sqrt(np.clip(s, 0, 1)) * (BINS - 1))).astype(np.int64) for s in stats]
    bins.append(np.array([0 if c is None or c < 0 else min(BINS - 1, 1 + max(0, int(c).bit_length() - 4)) for c in n_chars], np.int64))
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    value = value / np.maximum(norm[owner], 1e-9)
    extra = np.stack([BUCKETS + i * BINS + b for i, b in enumerate(bins)], axis=1).reshape(-1)
    number = np.concatenate([bucket, extra])
    owner = np.concatenate([owner, np.repeat(np.arange(n), len(bins))])
    value = np.concatenate([value, np.full(len(extra), 1 / np.sqrt(len(bins)))])
    order = np.argsort(owner, kind="stable")
    return number[order], value[order].astype(np.float32), np.searchsorted(owner[order], np.arange(n + 1))


class FactorisationMachine:
    def __init__(self, width: int = WIDTH, factors: int = FACTORS, seed: int = 7):
        self.b = np.float32(0)
        self.w = np.zeros(width, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (width, factors)).astype(np.float32)

    def margin(self, number: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Every text has features (its bins), so no slice between bounds is empty."""
        vx = self.v[number] * value[:, None]
        linear = np.add.reduceat(self.w[number] * value, bounds[:-1])
        total = np.add.reduceat(vx, bounds[:-1], axis=0)
        return self.b + linear + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), bounds[:-1]))

    def score(self, number: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(number, value, bounds), -30, 30))).astype(np.float64)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> FactorisationMachine:
        """AdaGrad on the log loss; ``rows`` are (numbers, values, label)."""
        rng = np.random.default_rng(3)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                own = [rows[j] for j in order[i : i + batch]]
                number, value = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
                bounds = np.cumsum([0, *(len(r[0]) for r in own)])
                label = np.array([r[2] for r in own], np.float32)
                err = ((self.score(number, value, bounds) - label) / len(own)).astype(np.float32)
                each = np.repeat(err, np.diff(bounds)) * value
                vx = self.v[number] * value[:, None]
                total = np.repeat(np.add.reduceat(vx, bounds[:-1], axis=0), np.diff(bounds), axis=0)
                dv = each[:, None] * (total - vx)
                at, where = np.unique(number, return_inverse=True)
                sw = np.bincount(where, each, len(at)).astype(np.float32) + decay * self.w[at]
                sv = np.zeros((len(at), self.v.shape[1]), np.float32)
                np.add.at(sv, where, dv)
                sv += decay * self.v[at]
                gw[at] += sw**2
                gv[at] += sv**2
                gb += float(err.sum()) ** 2
                self.w[at] -= rate * sw / np.sqrt(gw[at])
                self.v[at] -= rate * sv / np.sqrt(gv[at])
                self.b -= np.float32(rate * err.sum() / np.sqrt(gb))
        return self


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for part, texts in steps(batch, "text"):
        yield part, features(*raw(texts), part.column("n_chars").to_pylist())


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Train on at most ``rows`` labelled documents: the first of each of ``rows`` hash cells.

    ``docs`` has doc_id, text, n_chars; ``labels`` has doc_id, quality (0 or 1). Null labels and ids
    teach nothing; a doc_id with both labels counts as 0; rows that repeat a doc_id teach each. With no
    labels or documents nothing is learned, and scores are those of the initial weights. The driver
    receives the rows' features: a row has at most BUCKETS + 13 of 8 bytes each, however long its text.
    """
    at = F.xxhash64("doc_id")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picks = known.groupBy(F.pmod(at, F.lit(rows)).alias("cell")).agg(F.min(at).alias("h"))
    picks = known.join(F.broadcast(picks), at == picks.h).select(F.col("doc_id").alias("id"), "quality")
    sample = docs.join(F.broadcast(picks), docs.doc_id == picks.id).select("doc_id", "text", docs.n_chars.cast("long").alias("n_chars"), "quality")

    def run(batches):
        for batch in batches:
            for part, (number, value, bounds) in _columns(batch):
                cut = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.ListArray.from_arrays(cut, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value))], ["doc_id", "quality", "number", "value"])

    got = sample.mapInArrow(run, "doc_id long, quality int, number array<int>, value array<float>").toArrow()
    model = FactorisationMachine()
    if got.num_rows:
        got = got.sort_by("doc_id")
        number, value = (got.column(c).combine_chunks() for c in ("number", "value"))
        cut, number, value = number.offsets.to_numpy(), number.values.to_numpy(), value.values.to_numpy()
        model.fit([(number[a:b], value[a:b], q) for a, b, q in zip(cut[:-1], cut[1:], got.column("quality").to_pylist(), strict=True)])
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``docs`` (text, n_chars, any columns) with ``score`` in (0, 1) and ``predicted``.

    Null text is scored as empty text, null n_chars has a bin of its own. Columns named score or
    predicted are replaced; repeated rows get equal results, an empty table gives an empty result. Row
    by row, no shuffle.
    """
    sent = Sent(docs.sparkSession, model)
    docs = docs.drop("score", "predicted").withColumn("n_chars", F.col("n_chars").cast("long"))
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part, own in _columns(batch):
                score = sent.value.score(*own)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + own))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    out = score_quality(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
