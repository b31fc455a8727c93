"""Stream sketches over (seq, batch, user): relational forms that equal the sequential algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, coefficients, linear, myhashs, trailing_zeros


def bloom_fpr(stream: DataFrame, bits: int = 69997, hashes: int = 5) -> DataFrame:
    """(batch, fp, tn, fpr) of a Bloom filter that persists over batches.

    A user's first arrival is a false positive if all its bits were set before: each bit's first
    setter came earlier. So the whole filter is the table of first setters.
    """
    first = stream.groupBy("user").agg(F.min_by("batch", "seq").alias("batch"), F.min("seq").alias("seq"))
    each = first.select("user", "batch", "seq", F.explode(myhashs(F.col("user"), hashes, bits)).alias("bit"))
    setter = each.groupBy("bit").agg(F.min("seq").alias("set_at"))
    hit = each.join(setter, "bit").groupBy("user", "batch", "seq").agg(F.min((F.col("set_at") < F.col("seq")).cast("int")).alias("fp"))
    out = hit.groupBy("batch").agg(F.sum("fp").cast("long").alias("fp"), F.sum(1 - F.col("fp")).cast("long").alias("tn"))
    out = stream.select("batch").distinct().join(out, "batch", "left").fillna(0)
    return out.withColumn("fpr", F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0))


def fm_estimate(stream: DataFrame, hashes: int = 15, group: int = 3) -> DataFrame:
    """(batch, truth, estimate): Flajolet-Martin, mean within groups of hashes, median of the means."""
    tops = [F.max(trailing_zeros(linear(F.col("user"), a, b, PRIME, PRIME))).alias(f"t{i}") for i, (a, b) in enumerate(coefficients(hashes))]
    out = stream.groupBy("batch").agg(F.count_distinct("user").alias("truth"), *tops)
    power = lambda i: F.pow(F.lit(2.0), F.col(f"t{i}"))
    means = [sum((power(i) for i in range(g + 1, g + group)), power(g)) / group for g in range(0, hashes, group)]
    ordered = F.array_sort(F.array(*means))
    n = len(means)
    median = ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
    return out.select("batch", "truth", F.floor(median).cast("long").alias("estimate"))


def exact_distinct(stream: DataFrame) -> DataFrame:
    return stream.groupBy("batch").agg(F.count_distinct("user").alias("truth"))


def reservoir(stream: DataFrame, size: int, slots: list[int]) -> DataFrame:
    """(batch, n, slot, user): what the given slots of a fixed-size sample hold after each batch.

    The first ``size`` rows fill the slots in order; row n is then kept with probability size / n in a
    slot drawn by its number, so a slot holds the last row that it accepted.
    """
    n = F.col("seq") + 1
    (a, b), (c, d) = coefficients(2)
    keep = linear(n, a, b, PRIME, PRIME) * n < PRIME * size
    slot = F.when(n <= size, n - 1).otherwise(linear(n, c, d, PRIME, size))
    taken = stream.select("seq", "batch", "user", slot.alias("slot")).where((n <= size) | keep).where(F.col("slot").isin(slots))
    last = taken.groupBy("slot", "batch").agg(F.max_by("user", "seq").alias("user"))
    ends = stream.groupBy("batch").agg((F.max("seq") + 1).alias("n"))
    every = ends.withColumn("slot", F.explode(F.array(*[F.lit(s).cast("long") for s in slots])))
    run = W.partitionBy("slot").orderBy("batch")
    out = every.join(last, ["batch", "slot"], "left")
    return out.select("batch", "n", "slot", F.last("user", ignorenulls=True).over(run).alias("user"))


def window_distinct(events: DataFrame) -> DataFrame:
    """Distinct users of each day."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("n_user"))
