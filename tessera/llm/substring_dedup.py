"""Substring dedup by fixed-block anchors.

Blocks of k words at positions 0, k, 2k, ... of each text are the index; every rolling window of k
words probes it. A run of n >= 2k - 1 words that two texts share holds one whole block of either
text, so no repeat of n words can miss the index. Hits are extended to maximal exact runs: n - k + 1
consecutive windows that all occur in a second document, one of them anchored, are a candidate
for an n-word repeat, which a 128-bit hash of the n words then settles against the smallest doc_id.

Texts are dealt once into chunks of bounded size by hash. A chunk sends each distinct hash once
(32 bits beyond its bucket; false hits end in the second round), packed per bucket, so a passage
that a third of all documents share costs one entry for each chunk. Buckets answer in bitmaps
over the entries that they were sent, which the chunk derives anew from its texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, mix, raw, stream, strings, table, windows, word_hashes, words

#: Text bytes of a chunk, and those whose hashes meet in one bucket.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Text bytes whose chunks or buckets share a task.
TASK_BYTES = 32 << 20
SENT = "__chunk long, bucket long, keys binary, flags binary"
TOLD = "__chunk long, bucket long, phase int, some binary, anchored binary"
ASKED = "__chunk long, bucket long, high binary, low binary, ids binary"


class Chunk:
    """The words of a chunk and its distinct block hashes in the order of (bucket, hash)."""

    def __init__(self, docs: pa.Table, n: int, k: int, buckets: int):
        self.n, self.k, self.buckets = n, k, buckets
        texts = strings(docs.column("text"))
        self.data, self.offsets = raw(texts)
        self.starts, self.ends, self.doc, self.bounds = words(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        ids = docs.column("doc_id").combine_chunks()
        self.named = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        grams, at = windows(self.hashes, self.bounds, k)
        owner = self.doc[at]
        use = (self.named & (np.diff(self.bounds) >= n))[owner]
        grams, at, owner = grams[use], at[use], owner[use]
        order = np.lexsort((grams, grams % U64(buckets)))
        self.at, owner, grams = at[order], owner[order], grams[order]
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        self.entry = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        self.grams = grams[heads]
        self.aligned, self.several = np.zeros(len(heads), bool), np.zeros(len(heads), bool)
        if len(heads):
            own = self.ids[owner]
            self.several = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
            self.aligned = np.maximum.reduceat((self.at - self.bounds[owner]) % k == 0, heads)
        self.bucket = (self.grams % U64(buckets)).astype(np.int64)

    def sent(self, chunk: int) -> pa.Table:
        keys = (self.grams // U64(self.buckets)).astype(np.uint32)
        flags = self.aligned.astype(np.uint8) + 2 * self.several.astype(np.uint8)
        return packed(chunk, self.bucket, {"keys": keys, "flags": flags})

    def candidates(self, told: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of candidate n-word runs and their 128-bit hashes, by the answers of round 1."""
        some, anchored = spread(self.bucket, told, "some"), spread(self.bucket, told, "anchored")
        run = self.n - self.k + 1
        full, held = np.zeros(len(self.hashes) + 1, np.int32), np.zeros(len(self.hashes) + 1, np.int32)
        full[self.at + 1] = some[self.entry]
        held[self.at + 1] = (some & anchored)[self.entry]
        full, held = np.cumsum(full), np.cumsum(held)
        m = max(0, len(self.hashes) - run + 1)
        at = np.flatnonzero((full[run : run + m] - full[:m] == run) & (held[run : run + m] > held[:m]))
        # the second half comes of other hashes of the words, so no two words that collide deceive both
        edge = np.bincount(at, minlength=len(self.hashes) + 1) - np.bincount(at + self.n, minlength=len(self.hashes) + 1) if len(at) else np.zeros(1, np.int64)
        used = np.flatnonzero(np.cumsum(edge))
        other = np.zeros(len(self.hashes), U64)
        other[used] = word_hashes(self.data, self.starts[used], self.ends[used], seed=0x07E5)
        high, low = np.zeros(len(at), U64), np.zeros(len(at), U64)
        for x, y, j in zip(stream(0x413, self.n), stream(0x414, self.n), range(self.n), strict=True):
            high += self.hashes[at + j] * x
            low += other[at + j] * y
        return at, mix(high), mix(low)

    def asked(self, told: list[dict]):
        """(positions, entry of each, buckets, hashes and smallest ids of the distinct runs)."""
        at, high, low = self.candidates(told)
        bucket = (high % U64(self.buckets)).astype(np.int64)
        order = np.lexsort((low, high, bucket))
        at, high, low, bucket = at[order], high[order], low[order], bucket[order]
        first = np.ones(len(at), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        heads = np.flatnonzero(first)
        own = self.ids[self.doc[at]] if len(at) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(own, heads) if len(heads) else own
        return at, np.cumsum(first) - 1, bucket[heads], high[heads], low[heads], least

    def covered(self, first: list[dict], second: list[dict]) -> np.ndarray:
        """True for each word in an n-word run that starts in a document with a smaller id."""
        at, entry, bucket, _, _, least = self.asked(first)
        older = spread(bucket, second, "some")
        gone = older[entry] | (self.ids[self.doc[at]] > least[entry]) if len(at) else np.zeros(0, bool)
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + self.n, -1)
        return np.cumsum(edge)[:-1] > 0


def packed(chunk: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each bucket with the raw bytes of its slice; ``bucket`` is ascending."""
    own, at = np.unique(bucket, return_index=True)
    to = np.append(at[1:], len(bucket))[: len(at)]
    parts = {name: pa.array([v[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()) for name, v in columns.items()}
    return pa.table({"__chunk": pa.array(np.full(len(own), chunk)), "bucket": pa.array(own.astype(np.int64)), **parts})


def spread(bucket: np.ndarray, told: list[dict], name: str) -> np.ndarray:
    """Bitmaps of the buckets back on the entries in the order of ``bucket``."""
    out = np.zeros(len(bucket), bool)
    for x in told:
        a, b = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(x[name], np.uint8), count=b - a).astype(bool)
    return out


def _joined(t: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _answers(t: pa.Table, phase: int, cuts: np.ndarray, some: np.ndarray, anchored: np.ndarray) -> pa.Table:
    rows = [(c, some[a:b], anchored[a:b]) for c, a, b in zip(t.column("__chunk").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    rows = [x for x in rows if x[1].any()]
    bits = lambda i: pa.array([np.packbits(x[i]).tobytes() for x in rows], pa.binary())
    return pa.table({
        "__chunk": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array(np.full(len(rows), t.column("bucket")[0].as_py())),
        "phase": pa.array(np.full(len(rows), phase, np.int32)), "some": bits(1), "anchored": bits(2),
    })


def _meet_blocks(t: pa.Table) -> pa.Table:
    """Round 1 in one bucket: which hashes occur in two documents, and which are in the index."""
    keys, cuts = _joined(t, "keys", np.uint32)
    flags, _ = _joined(t, "flags", np.uint8)
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.bincount(where, flags >= 2) > 0
    aligned = np.bincount(where, flags & 1) > 0
    return _answers(t, 1, cuts, ((count > 1) | several)[where], aligned[where])


def _meet_runs(t: pa.Table) -> pa.Table:
    """Round 2 in one bucket: which runs start in a document with a smaller id than the asker's."""
    (high, cuts), (low, _), (ids, _) = _joined(t, "high", U64), _joined(t, "low", U64), _joined(t, "ids", np.int64)
    order = np.lexsort((ids, low, high))
    h, lo = high[order], low[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    older = np.zeros(len(ids), bool)
    older[order] = least < ids[order]
    return _answers(t, 2, cuts, older, older)


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _cleaned(docs: pa.Table, gone: np.ndarray, c: Chunk, names: list[str], schema: pa.Schema) -> pa.Table:
    data = c.data.tobytes()
    text, spans, removed = [], [], []
    old = docs.column("text").to_pylist()
    for i, t in enumerate(old):
        a, b = c.bounds[i], c.bounds[i + 1]
        out = gone[a:b]
        removed.append(int(out.sum()))
        if not removed[-1]:
            text.append(t)
            spans.append([])
            continue
        spans.append(_spans(out))
        at, kept = int(c.offsets[i]), []
        for s in spans[-1]:  # a removed word goes with the separators after it
            kept.append(data[at : c.starts[a + s["start"]]])
            at = int(c.starts[a + s["end"]] if a + s["end"] < b else c.offsets[i + 1])
        text.append((b"".join(kept) + data[at : c.offsets[i + 1]]).decode())
    own = {"text": text, "n_words": np.diff(c.bounds), "n_removed": removed, "removed": spans}
    return pa.table([pa.array(own[x], schema.field(x).type) if x in own else docs.column(x).combine_chunks() for x in names], schema=schema)


def _apart(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` dealt by ``key`` over a task for each TASK_BYTES, where the session's partitions are fewer."""
    tasks = math.ceil(size / TASK_BYTES)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def substring_dedup(docs: DataFrame, min_words: int = 50, block_words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with each repeated run of words cut out.

    A word goes if it lies in a run of ``min_words`` consecutive words of its document that also
    starts in a document with a smaller doc_id, judged on the input. ``text`` is the rest, each
    kept word with the separators after it; ``n_words`` counts the words before, ``n_removed``
    those cut, ``removed`` lists their word spans (start, end). Other columns pass unchanged; of
    the same name as one of these, they are replaced.

    Null text has no words and stays null. Rows with a null doc_id neither lose words nor are a
    reason to cut others. Rows that repeat a doc_id don't affect each other. An empty table gives
    an empty result. ``block_words`` may be at most (min_words + 1) / 2, its default.
    """
    n, k = min_words, block_words or (min_words + 1) // 2
    if n < 2 * k - 1 or k < 1:
        raise ValueError("a run must hold a whole block: min_words >= 2 * block_words - 1")
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks, buckets = math.ceil(size / CHUNK_BYTES) or 1, math.ceil(size / BUCKET_BYTES) or 1
    dealt = _apart(docs.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), "__chunk", size)
    names = [c for c in docs.columns] + ["n_words", "n_removed", "removed"]
    fields = [f for f in docs.schema.fields] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
    out_schema = T.StructType(fields)
    arrow = to_arrow_schema(out_schema)

    def send(t: pa.Table) -> pa.Table:
        return Chunk(t, n, k, buckets).sent(t.column("__chunk")[0].as_py())

    def ask(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or not told.num_rows:
            return pa.table({"__chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), **{x: pa.array([], pa.binary()) for x in ("high", "low", "ids")}})
        _, _, bucket, high, low, least = Chunk(t, n, k, buckets).asked(told.to_pylist())
        return packed(t.column("__chunk")[0].as_py(), bucket, {"high": high, "low": low, "ids": least})

    def clean(t: pa.Table, told: pa.Table) -> pa.Table:
        c = Chunk(t, n, k, buckets)
        rows = told.to_pylist()
        gone = c.covered([x for x in rows if x["phase"] == 1], [x for x in rows if x["phase"] == 2])
        return _cleaned(t, gone, c, names, arrow)

    sent = _apart(dealt.groupBy("__chunk").applyInArrow(send, SENT), "bucket", size)
    first = sent.groupBy("bucket").applyInArrow(_meet_blocks, TOLD)
    asked = _apart(dealt.groupBy("__chunk").cogroup(first.groupBy("__chunk")).applyInArrow(ask, ASKED), "bucket", size)
    second = asked.groupBy("bucket").applyInArrow(_meet_runs, TOLD)
    told = first.unionByName(second)
    return dealt.groupBy("__chunk").cogroup(told.groupBy("__chunk")).applyInArrow(clean, out_schema)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(docs, min_words=13)
    kept = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    kept = F.sha2(F.regexp_replace(kept, r"[\x20\x09-\x0D]+", " "), 256)
    return out.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p
), f AS (
  SELECT s, min(doc_id) AS least FROM g GROUP BY s
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (s) WHERE least < doc_id
), r AS (
  SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ks, i)), lambda i: ws[i]), ' ') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
