"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text.
A document is parsed greedily into the longest phrases that the automaton accepts (a byte that it
never saw is a phrase of its own); phrases times log2 of the training length, over the document's
length, estimates the cross entropy, and the least wins.

The parse is that of the whole text, found for segments in lockstep, one table lookup for a byte of
every segment at once. At first no segment knows the phrase that is open at its start; then each is
parsed again from the state that the one before ends in, up to the byte where both parses are in one
state, as they agree from there on. Segments whose start has changed by that go round again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, crc_mod, raw, steps, strings, table

#: Training bytes of a language (its automaton has less than twice as many states, so 16 bits hold
#: a state), the documents they come from at most, and the characters taken from each at most.
TRAIN_BYTES, TRAIN_DOCS, PIECE = 30_000, 256, 400
SEGMENT = 256
FAIL = 65535
PAD, UNSEEN = 0, 1


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes with every byte that can't be part of a letter as a space."""
    data, offsets = raw(strings(pc.utf8_lower(texts)))
    return SPACED[data], offsets


SPACED = np.full(256, 32, np.uint8)
SPACED[97:123] = np.arange(97, 123)
SPACED[128:] = np.arange(128, 256)


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root, every state accepts."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class LanguageModel:
    """Automata of some languages as dense tables over one alphabet of bytes."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        seen = sorted({*b"".join(texts.values())})
        self.code = np.full(256, UNSEEN, np.uint8)
        self.code[seen] = np.arange(2, 2 + len(seen))
        self.tables, self.bits = [], []
        for lang in self.langs:
            own = automaton(texts[lang][:TRAIN_BYTES])
            out = np.full((len(own) + 1, 2 + len(seen)), FAIL, np.uint16)  # the last row: no phrase is open
            out[:, PAD] = 0
            for s, edges in enumerate(own):
                for c, to in edges.items():
                    out[s, self.code[c]] = to
            self.tables.append(out.reshape(-1))
            self.bits.append(np.log2(max(2, len(texts[lang][:TRAIN_BYTES]))))
        self.width = 2 + len(seen)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """n_texts x n_languages phrase counts of the greedy parses."""
        lengths = np.diff(offsets)
        rows = -(-lengths // SEGMENT)
        total = int(rows.sum())
        out = np.zeros((len(lengths), len(self.langs)), np.int64)
        if not total:
            return out
        owner = np.repeat(np.arange(len(lengths)), rows)
        first = np.cumsum(rows) - rows
        start = offsets[:-1][owner] + (np.arange(total) - first[owner]) * SEGMENT
        size = np.minimum(SEGMENT, offsets[1:][owner] - start)
        order = np.argsort(-size, kind="stable")  # so that the segments still open are a head
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        later = later[np.argsort(place[later], kind="stable")]
        own, before = place[later], place[later - 1]  # segments and those that go before them
        start, size, owner = start[order], size[order], owner[order]
        codes = self.code[data]
        live = np.searchsorted(-size, -np.arange(SEGMENT), "left")
        for j, flat in enumerate(self.tables):
            closed = len(flat) // self.width - 1
            root = np.where(flat[: self.width] == FAIL, closed, flat[: self.width])
            states, bad = np.zeros((SEGMENT, total), np.uint16), np.zeros((SEGMENT, total), bool)
            state = np.full(total, closed, np.int32)
            for i in range(SEGMENT):
                n = live[i]
                if not n:
                    break
                c = codes[start[:n] + i]
                to = flat[state[:n] * np.int32(self.width) + c]
                np.equal(to, FAIL, out=bad[i, :n])
                state[:n] = np.where(bad[i, :n], root[c], to)
                states[i, :n] = state[:n]
            entry = np.full(total, closed, np.int32)
            while len(changed := np.flatnonzero(state[before] != entry[own])):
                again = own[changed]
                entry[again] = state[before[changed]]
                state[again] = self._again(flat, root, codes, start, size, again, entry[again], states, bad)
            out[:, j] = np.bincount(owner, bad.sum(axis=0), len(lengths)).astype(np.int64)
        return out

    def _again(self, flat, root, codes, start, size, again, state, states, bad) -> np.ndarray:
        """Parse the segments ``again`` (longest first) from other states; the states at their ends."""
        live = again
        for i in range(SEGMENT):
            n = int(np.searchsorted(-size[live], -i, "left"))
            live, state = live[:n], state[:n]
            if not n:
                break
            c = codes[start[live] + i]
            to = flat[state * np.int32(self.width) + c]
            bad[i, live] = to == FAIL
            state = np.where(to == FAIL, root[c], to).astype(np.int32)
            open_ = states[i, live] != state
            live, state = live[open_], state[open_]
            states[i, live] = state
        return states[size[again] - 1, again].astype(np.int32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = coded(texts)
        lengths = np.maximum(1, np.diff(offsets))
        if not self.langs:
            return ["und"] * len(lengths), np.zeros(len(lengths))
        bits = self.phrases(data, offsets) * np.array(self.bits)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) / lengths[:, None] * np.minimum(lengths, 64)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        letters = np.concatenate([[0], np.cumsum(data != 32)])
        some = letters[offsets[1:]] > letters[offsets[:-1]]
        ascii_ = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        unsure = np.flatnonzero(some & (ascii_[offsets[1:]] == ascii_[offsets[:-1]]))
        for i in unsure:  # only bytes of other scripts: they may be symbols
            some[i] = any(map(str.isalpha, texts[int(i)].as_py()))
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def fit(docs: DataFrame, cells: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); rows with a null among these teach nothing.

    The sample is one document of each of ``cells`` hash cells of every language, so its size is
    bounded whatever the corpus is. TRAIN_BYTES is shared out evenly among a language's documents, and
    each gives so many characters from around its middle, PIECE at most; only of letters of several
    bytes is a part not used then. Repeated rows count once. An empty table teaches nothing.
    """
    at = F.xxhash64("doc_id")
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    picks = known.groupBy("lang", F.pmod(at, F.lit(cells)).alias("cell")).agg(F.min(at).alias("h"))
    share = F.floor(F.lit(TRAIN_BYTES) / F.count("*").over(W.partitionBy("lang"))).cast("int") - 1  # a space goes after each
    picks = picks.select(F.col("lang").alias("l"), "h", share.alias("share"))
    middle = F.greatest(F.lit(1), (F.length("text") - PIECE) / 2).cast("int")
    rows = known.select("lang", at.alias("at"), F.substring("text", middle, F.lit(PIECE)).alias("text"))
    found = rows.join(picks, (rows.at == picks.h) & (rows.lang == picks.l)).dropDuplicates(["lang", "at"])
    found = found.select("lang", "at", "share", F.substring("text", F.lit(1), F.col("share")).alias("text")).collect()
    texts: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.at)):
        texts[r.lang] = texts.get(r.lang, b"") + coded(pa.array([r.text]))[0].tobytes()[: r.share] + b" "
    return LanguageModel(texts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (text, any columns) with ``lang_pred`` and ``score`` (0 to 1).

    Null text or text without a letter: ``und`` and 0; so are all rows if nothing was learned. A tie
    goes to the language first in order. Columns of these two names are replaced; repeated rows get
    equal results, an empty table gives an empty result. No shuffle.
    """
    sent = Sent(docs.sparkSession, model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                langs, score = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    own = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + own.fields))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
