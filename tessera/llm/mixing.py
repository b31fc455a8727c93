"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

Source token shares p are raised to an exponent in 0..1 and normalised. Bisection finds the largest
exponent (the weights nearest to the corpus) that meets a target entropy of the weights, and then the
smallest one, if need be, that keeps every source under a repetition limit. The weights become token
budgets, and every source fills its own by whole documents: epoch by epoch, its blocks in a new
permutation for each epoch, up to the budget's end.

Blocks are hash cells of about BLOCK_DOCS documents, so a source of any size is many small groups.
Prefix sums run over blocks within superblocks, superblocks within a source, and documents within a
block; no source is ever in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

#: Target entropy as a share of the largest possible, most epochs of a source, documents in a block.
ENTROPY_SHARE, MAX_EPOCHS, BLOCK_DOCS, SUPER = 0.95, 4.0, 256, 1024
#: Sources up to this number are broadcast; more are joined by a shuffle.
SMALL = 100_000
#: Steps of bisection that one job answers.
AHEAD = 5


def bisect(ok: Callable[[list[float]], list[bool]], low: float, high: float, rounds: int = 8) -> float:
    """The end of the part of [low, high] on which ``ok`` holds; it holds at ``low``.

    ``ok`` judges many points at once: each round asks for all midpoints that AHEAD steps can reach.
    """
    if ok([high])[0]:
        return high
    cells = 1 << AHEAD
    for _ in range(rounds):
        at = [low + (high - low) * j / cells for j in range(cells + 1)]
        yes = [True, *ok(at[1:-1]), False]
        lo, hi = 0, cells
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if yes[mid] else (lo, mid)
        low, high = at[lo], at[hi]
    return low


def exponent(sources: DataFrame, entropy_share: float, max_epochs: float, budget: float | None) -> tuple[float, float, float]:
    """(exponent, sum of the powered shares, all tokens) for ``sources`` (source, tokens > 0).

    One aggregate over the table of sources answers AHEAD steps: no source reaches the driver.
    """
    total, n = sources.agg(F.sum("tokens"), F.count("*")).head()
    if not n:
        return 1.0, 1.0, 0.0
    spend = float(budget or total)

    def stats(points: list[float]) -> list[tuple[float, float, float]]:
        """(sum of the powered shares, entropy, most epochs of a source) at each exponent."""
        p, w = F.col("tokens") / F.lit(float(total)), F.col("w")
        each = sources.select("tokens", F.explode(F.array(*map(F.lit, points))).alias("a")).withColumn("w", F.pow(p, F.col("a")))
        found = each.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("h"), F.max(w / F.col("tokens")).alias("m")).collect()
        by = {r.a: (r.z, math.log(r.z) - r.h / r.z, r.m / r.z * spend) for r in found}
        return [by[a] for a in points]

    # entropy falls as the exponent grows; it is largest (log n) at 0
    a = bisect(lambda xs: [h >= entropy_share * math.log(n) for _, h, _ in stats(xs)], 0.0, 1.0) if n > 1 else 1.0
    # the repetition of the scarcest source falls as the exponent grows towards 1
    (z, _, now), (_, _, least) = stats([a])[0], stats([1.0])[0]
    if now > max_epochs:
        few = lambda xs: [m <= max_epochs for _, _, m in stats([1 - x for x in xs])]
        a = 1 - bisect(few, 0.0, 1 - a) if least <= max_epochs else 1.0
        z = stats([a])[0][0]
    return a, z, float(total)


def _joined(big: DataFrame, small: DataFrame, on: list[str], rows: int) -> DataFrame:
    return big.join(F.broadcast(small) if rows <= SMALL else small, on)


def mix(
    docs: DataFrame,
    entropy_share: float = ENTROPY_SHARE,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    tokens: Column | None = None,
    seed: int = 17,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row for each time that a document is in the mix: doc_id, source, n_tokens, epoch, weight
    (its source's), ``position`` (0 to 1: reading by it keeps the weights throughout).

    ``budget`` is the mix's tokens (default: the corpus's); a source gets weight x budget and takes
    whole documents until its budget is used, so it exceeds it by one document at most. A budget of
    more than ``max_epochs`` corpora can't keep the limit: the weights are then the corpus's own, which
    repeat the scarcest source least. ``tokens``
    defaults to the words of ``text``. A null source is a source of its own, called ''. Documents
    without tokens (null or blank text) can't fill a budget and are left out. Repeated rows are
    drawn each; a null doc_id is drawn like any other. Extra columns are ignored. An empty table
    gives an empty mix.
    """
    n_tokens = tokens if tokens is not None else F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens.cast("long").alias("n_tokens")).where("n_tokens > 0")
    slim = stored(slim, "sized")
    sources = stored(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    n_sources = sources.count()
    a, z, total = exponent(sources, entropy_share, max_epochs, budget)
    spend = float(budget or total)
    weight = F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(a)) / F.lit(z)
    plan = sources.select("source", "tokens", "docs", weight.alias("weight"))
    plan = plan.withColumn("budget", F.floor(F.col("weight") * spend).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long"))
    plan = plan.withColumn("epochs", F.ceil(F.col("budget") / F.col("tokens")).cast("long"))
    plan = stored(plan, "plan")

    at = F.xxhash64(F.lit(seed), "doc_id", "n_tokens")
    own = _joined(slim, plan.select("source", "blocks"), ["source"], n_sources).withColumn("block", F.pmod(at, "blocks")).drop("blocks")
    sums = stored(own.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block")), "blocks")
    # every epoch has its own order of blocks; the order's cells are its superblocks
    drawn = _joined(sums, plan.where("epochs > 0").select("source", "tokens", "budget", "weight", "epochs", "blocks"), ["source"], n_sources)
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    order = F.xxhash64(F.lit(seed + 1), "source", "block", "epoch")
    drawn = drawn.withColumn("order", order).withColumn("cell", F.shiftrightunsigned("order", 1) % F.ceil(F.col("blocks") / SUPER))
    drawn = stored(drawn, "drawn")
    cells = drawn.groupBy("source", "epoch", "cell").agg(F.sum("in_block").alias("in_cell"))
    before = W.partitionBy("source", "epoch").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_at", F.coalesce(F.sum("in_cell").over(before), F.lit(0))).drop("in_cell")
    inner = W.partitionBy("source", "epoch", "cell").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)
    drawn = drawn.withColumn("block_at", F.coalesce(F.sum("in_block").over(inner), F.lit(0))).join(cells, ["source", "epoch", "cell"])
    start = F.col("epoch") * F.col("tokens") + F.col("cell_at") + F.col("block_at")
    drawn = drawn.withColumn("start", start).where("start < budget").select("source", "block", "epoch", "start", "budget", "weight")

    within = W.partitionBy("source", "block").orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("at", at).withColumn("doc_at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = own.join(drawn, ["source", "block"]).withColumn("begin", F.col("start") + F.col("doc_at")).where("begin < budget")
    return out.select("doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "weight", (F.col("begin") / F.col("budget")).alias("position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
