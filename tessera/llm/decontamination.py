"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the n-grams of test items that the corpus's word frequencies make unlikely by chance
(frequencies, not n-gram counts, so a passage that leaked into many documents stays a seed); each
item keeps at least the rarer half of its n-grams. Where a document has a seed, the passage around it
is aligned with the item, word by word, so edited and paraphrased copies score by what they keep.

The corpus is never shuffled: test items go to the tasks in blocks of bounded size, one pass over
the documents for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, raw, steps, strings, table, windows, word_hashes, words

#: Words of a seed, the chance below which an n-gram is rare, and the bytes of items in a block.
SEED_WORDS, RARE, BLOCK_BYTES = 3, 1e-8, 8 << 20
#: Alignment scores, and the share of an item's perfect score from which a document is a leak.
MATCH, MISMATCH, GAP, LEAK = 2, -1, -1, 0.4

#: Bytes outside words: all ASCII but letters and digits.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text, punctuation apart, and n_texts+1 bounds."""
    data, offsets = raw(strings(pc.utf8_lower(texts)))
    starts, ends, _, bounds = words(data, offsets, SEPARATOR)
    return word_hashes(data, starts, ends), bounds


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (linear gaps) of two word sequences, and where it ends in the passage."""
    m = len(passage)
    slope = GAP * np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.zeros(m + 1, np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step - slope) + slope  # gaps along the passage
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED_WORDS):
        self.n = n
        self.ids = [i for i, _ in items]
        self.hashes, self.bounds = tokens(pa.array([t for _, t in items], pa.large_string()))
        self.words = np.unique(self.hashes)
        self.seeds = np.zeros(0, np.uint64)

    def choose(self, counts: np.ndarray, total: int, rare: float = RARE) -> Index:
        """Keep the rare n-grams by the corpus counts of ``words``; short items are one seed each."""
        chance = np.log((counts + 0.5) / max(1, total))[np.searchsorted(self.words, self.hashes)]
        sums = np.concatenate([[0], np.cumsum(chance)])
        length = np.diff(self.bounds)
        grams, at = windows(self.hashes, self.bounds, self.n)
        log = sums[at + self.n] - sums[at]
        item = np.searchsorted(self.bounds, at, "right") - 1
        keep = log <= math.log(rare)
        order = np.lexsort((log, item))
        rank = np.arange(len(at)) - np.searchsorted(item[order], item[order])
        half = np.zeros(len(at), bool)
        half[order] = rank * 2 < np.maximum(0, length - self.n + 1)[item[order]]
        keep |= half
        grams, item, offset = grams[keep], item[keep], (at - self.bounds[item])[keep]
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.offset = grams[order], item[order], offset[order]
        self.seeds = np.unique(self.grams)
        self.short = {k: [*np.flatnonzero(length == k)] for k in range(1, self.n) if (length == k).any()}
        return self

    def look(self, hashes: np.ndarray, bounds: np.ndarray, leak: float) -> dict[int, list[tuple[float, int, int, int, int]]]:
        """By text: score, item number, seed hits, and the word span that was aligned, of its best item
        and then of every other item that scores ``leak`` or more."""
        grams, at = windows(hashes, bounds, self.n)
        found = hits(self.seeds, grams)
        grams, at = grams[found], at[found]
        a, b = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        each = np.repeat(np.arange(len(at)), b - a)
        entry = np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        pos, item, shift = at[each], self.item[entry], self.offset[entry]
        for k, items in self.short.items():  # items shorter than a seed: all their words at once
            for i in items:
                whole, where = windows(hashes, bounds, k), windows(self.hashes[self.bounds[i] : self.bounds[i + 1]], np.array([0, k]), k)
                own = whole[1][whole[0] == where[0][0]]
                pos, item, shift = np.append(pos, own), np.append(item, np.full(len(own), i)), np.append(shift, np.zeros(len(own), np.int64))
        if not len(pos):
            return {}
        doc = np.searchsorted(bounds, pos, "right") - 1
        length = np.diff(self.bounds)[item]
        pad = length * 3 // 10 + 3
        low, high = np.maximum(bounds[doc], pos - shift - pad), np.minimum(bounds[doc + 1], pos - shift + length + pad)
        order = np.lexsort((low, item, doc))
        out: dict[int, list[tuple[float, int, int, int, int]]] = {}
        i = 0
        while i < len(order):
            d, t = doc[order[i]], item[order[i]]
            j, n_hits, best = i, 0, (0.0, 0, 0)
            while j < len(order) and doc[order[j]] == d and item[order[j]] == t:
                x, y = low[order[j]], high[order[j]]
                k = j + 1
                while k < len(order) and doc[order[k]] == d and item[order[k]] == t and low[order[k]] <= y:
                    y = max(y, high[order[k]])
                    k += 1
                n_hits += k - j
                own = self.hashes[self.bounds[t] : self.bounds[t + 1]]
                score, end = align(own, hashes[x:y])
                best = max(best, (score / (MATCH * len(own)), -int(x), int(x + end)))
                j = k
            own = out.setdefault(int(d), [])
            new = (best[0], int(t), n_hits, -best[1], best[2])
            if not own or (best[0], -t) > (own[0][0], -own[0][1]):
                own.insert(0, new)
            else:
                own.append(new)
            out[int(d)] = own[:1] + [x for x in own[1:] if x[0] >= leak]
            i = j
        for d, own in out.items():  # where it starts: the same from its end backwards
            for k, (score, t, n_hits, x, y) in enumerate(own):
                back = align(self.hashes[self.bounds[t] : self.bounds[t + 1]][::-1], hashes[x:y][::-1])[1]
                own[k] = (score, t, n_hits, int(y - back - bounds[d]), int(y - bounds[d]))
        return out


def hits(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of the given word hashes over all documents, and the number of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = sent.value
        counts, total = np.zeros(len(known) + 1, np.int64), 0
        for batch in batches:
            for _, texts in steps(batch, "text"):
                hashes, _ = tokens(texts)
                total += len(hashes)
                if len(known):
                    at = np.searchsorted(known, hashes)
                    at[at == len(known)] = 0
                    counts[:-1] += np.bincount(at[known[at] == hashes], minlength=len(known))
        counts[-1] = total
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text, any columns) with the best-aligned test item of each.

    Adds ``item_id`` (null if no item has a seed in it), ``score`` (share of the item's perfect
    alignment score), ``n_seeds``, the aligned word span ``span_start``, ``span_end`` and
    ``contaminated`` (score >= leak); a tie goes to the smaller item_id. ``leaked`` lists every item
    with score >= leak, by item_id, each with its best span. Columns of these names are
    replaced. Null and wordless texts have no item and score 0; items with a null id or without
    words match nothing; an empty benchmark leaves every document clean. Repeated rows are judged
    one by one.
    """
    spark = docs.sparkSession
    own = T.StructType.fromDDL("item_id long, score double, n_seeds long, span_start long, span_end long, leaked array<struct<item_id: long, score: double, n_seeds: long, span_start: long, span_end: long>>")
    docs = docs.drop(*own.names, "contaminated")
    plain = docs
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = math.ceil(size / block_bytes)
    schema = T.StructType(docs.schema.fields + own.fields)
    for f in own.fields:
        docs = docs.withColumn(f.name, F.array().cast(f.dataType) if f.name == "leaked" else F.lit(0 if f.name in ("score", "n_seeds") else None).cast(f.dataType))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect()
        index = Index(sorted((r.item_id, r.text) for r in part))
        index.choose(*word_counts(plain, index.words))
        docs = docs.mapInArrow(_pass(Sent(spark, index), own.names[:-1], leak), schema)
    return docs.withColumn("contaminated", F.col("score") >= leak)


def _pass(sent, added: list[str], leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part, texts in steps(batch, "text"):
                new = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in [*added, "leaked"]}
                for d, own in index.look(*tokens(texts), leak).items():
                    every = [dict(zip(added, (index.ids[t], score, n, x, y), strict=True)) for score, t, n, x, y in own]
                    new["leaked"][d] = sorted(new["leaked"][d] + [e for e in every if e["score"] >= leak], key=lambda e: (e["item_id"], e["span_start"]))
                    row = tuple(every[0].values())
                    score = row[1]
                    if score > new["score"][d] or new["item_id"][d] is None or (score == new["score"][d] and row[0] < new["item_id"][d]):
                        for c, v in zip(added, row, strict=True):
                            new[c][d] = v
                arrays = [pa.array(new[c], part.schema.field(c).type) if c in new else part.column(i) for i, c in enumerate(part.schema.names)]
                yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    return run


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
