"""Structured Streaming forms of the sketches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, coefficients, linear, trailing_zeros


def fm_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour", hashes: int = 15, group: int = 3) -> DataFrame:
    """(start, estimate): Flajolet-Martin distinct users of each event-time window, append mode."""
    tops = [F.max(trailing_zeros(linear(F.col("user_id"), a, b, PRIME, PRIME))).alias(f"t{i}") for i, (a, b) in enumerate(coefficients(hashes))]
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window)).agg(*tops)
    means = [sum((F.pow(F.lit(2.0), F.col(f"t{i}")) for i in range(g + 1, g + group)), F.pow(F.lit(2.0), F.col(f"t{g}"))) / group for g in range(0, hashes, group)]
    return out.select(F.col("window.start").alias("start"), F.floor(F.array_sort(F.array(*means))[len(means) // 2]).cast("long").alias("estimate"))


def bloom_stream(stream: DataFrame, bits: int = 69997, hashes: int = 5, shards: int = 1) -> DataFrame:
    """(shard, fp, tn) of each micro-batch of (seq, user): a filter whose bits and exact set are
    state. Users are dealt to ``shards`` filters; one shard is the sequential algorithm."""
    pairs = coefficients(hashes)
    schema = "shard long, fp long, tn long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else (bytes(bits // 8 + 1), [])
        held, seen = bytearray(held), set(seen)
        fp = tn = 0
        rows = pd.concat(list(batches)).sort_values("seq")
        for user in rows["user"].astype(int):
            if user in seen:
                continue
            at = [((user % PRIME) * a + b) % PRIME % bits for a, b in pairs]
            if all(held[p >> 3] >> (p & 7) & 1 for p in at):
                fp += 1
            else:
                tn += 1
            for p in at:
                held[p >> 3] |= 1 << (p & 7)
            seen.add(user)
        state.update((bytes(held), sorted(seen)))
        yield pd.DataFrame({"shard": [key[0]], "fp": [fp], "tn": [tn]})

    own = stream.withColumn("shard", F.pmod(F.xxhash64("user"), F.lit(shards)))
    return own.groupBy("shard").applyInPandasWithState(run, schema, "bits binary, seen array<long>", "append", "NoTimeout")


def reservoir_stream(stream: DataFrame, size: int) -> DataFrame:
    """(n, sample) after each micro-batch of (seq, user): a fixed-size sample held as state, by the
    same hashed decisions as the relational form."""
    (a, b), (c, d) = coefficients(2)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, sample = state.get if state.exists else (0, [])
        sample = list(sample)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            n = int(r.seq) + 1
            if n <= size:
                sample.append(int(r.user))
            elif ((n % PRIME) * a + b) % PRIME * n < PRIME * size:
                sample[((n % PRIME) * c + d) % PRIME % size] = int(r.user)
        state.update((n, sample))
        yield pd.DataFrame({"n": [n], "sample": [sample]})

    own = stream.withColumn("one", F.lit(0))
    return own.groupBy("one").applyInPandasWithState(run, "n long, sample array<long>", "n long, sample array<long>", "append", "NoTimeout")
