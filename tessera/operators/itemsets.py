"""Frequent itemsets: two basket models, SON first pass and level-wise A-priori.

Baskets stay exploded as (basket, item). Itemsets are sorted arrays of strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import stored


def transposed(baskets: DataFrame) -> DataFrame:
    """The second basket model: items become baskets."""
    return baskets.select(F.col("item").alias("basket"), F.col("basket").alias("item"))


def larger_than(baskets: DataFrame, k: int) -> DataFrame:
    """Rows of baskets with more than k items."""
    keep = baskets.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > k).select("basket")
    return baskets.join(keep, "basket", "left_semi")


def son_candidates(baskets: DataFrame, support: int, chunks: int = 10, strict: bool = False) -> DataFrame:
    """Items that reach ceil(support / chunks) in at least one chunk of baskets. Every frequent item is
    among them: counts below the share in every chunk sum to less than the support. ``strict`` asks for
    more than that share, which may lose frequent items that are spread evenly.

    A whole number's chunk is its remainder, any other key's that of its hash."""
    least = -(-support // chunks) + strict
    whole = isinstance(baskets.schema["basket"].dataType, T.IntegralType)
    chunk = F.pmod(F.col("basket").cast("long") if whole else F.xxhash64("basket"), F.lit(chunks))
    return baskets.groupBy(chunk.alias("chunk"), "item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item").distinct()


def frequent_items(baskets: DataFrame, support: int) -> DataFrame:
    return baskets.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select(F.array("item").alias("items"), "n")


def candidates(frequent: DataFrame, k: int, prune: str = "all_subsets") -> DataFrame:
    """k-itemsets joined from (k-1)-itemsets with an equal prefix. ``prune``: ``all_subsets`` keeps
    those whose every (k-1)-subset is frequent, ``none`` keeps all; frequent sets come out alike."""
    head = F.slice("items", 1, k - 2)
    side = lambda c: frequent.select(head.alias("head"), F.element_at("items", -1).alias(c))
    out = side("x").join(side("y"), "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("items"))
    if prune == "none" or k < 3:
        return out
    subset = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.concat(F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.lit(k))))
    each = out.select("items", F.explode(subset).alias("sub"))
    held = each.join(frequent.select(F.col("items").alias("sub")), "sub", "left_semi")
    return held.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == k - 2).select("items")


def count_candidates(baskets: DataFrame, occurrences: DataFrame, cands: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(frequent itemsets, their occurrences): occurrences (basket, items) of the level below grow by
    a larger item of the same basket, and only candidates are counted."""
    grown = occurrences.join(baskets, "basket").where(F.col("item") > F.element_at("items", -1))
    grown = grown.select("basket", F.concat("items", F.array("item")).alias("items")).join(cands, "items", "left_semi")
    frequent = grown.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    return frequent, grown.join(frequent.select("items"), "items", "left_semi")


def apriori(baskets: DataFrame, support: int, most: int | None = None, prune: str = "all_subsets", chunks: int = 10, strict: bool = False) -> DataFrame:
    """(size, kind, items, n): ``candidate`` rows (n null) and ``frequent`` rows of all levels.

    Candidates of size 1 are those of the first pass over ``chunks`` (``son_candidates``). Each level is
    a table in the shared folder; the driver only sees whether one is empty.
    """
    baskets = stored(baskets.select("basket", F.col("item").cast("string").alias("item")).distinct(), "baskets")
    found = stored(son_candidates(baskets, support, chunks, strict), "first")
    level = stored(frequent_items(baskets.join(found, "item", "left_semi"), support), "level")
    first = found.select(F.array("item").alias("items"))
    rows = lambda df, k, kind, n: df.select(F.lit(k).alias("size"), F.lit(kind).alias("kind"), "items", n)
    none = F.lit(None).cast("long").alias("n")
    out = rows(first, 1, "candidate", none).union(rows(level, 1, "frequent", F.col("n")))
    good = stored(baskets.join(level.select(F.col("items")[0].alias("item")), "item", "left_semi").select("basket", "item"), "good")
    occurrences, k = good.select("basket", F.array("item").alias("items")), 2
    while (most is None or k <= most) and level.limit(2).count() == 2:
        cands = stored(candidates(level, k, prune), "candidates")
        frequent, grown = count_candidates(good, occurrences, cands, support)
        level = stored(frequent, "level")
        occurrences = stored(grown, "occurrences")
        out = out.union(rows(cands, k, "candidate", none)).union(rows(level, k, "frequent", F.col("n")))
        k += 1
    return out


def report(itemsets: DataFrame) -> DataFrame:
    """Text lines ``(size, kind, line)``: ``('a'),('b')`` or ``('a', 'b'),...`` sorted within a line."""
    shown = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    return itemsets.groupBy("size", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("items", shown.alias("s")))), lambda x: x["s"]), ",").alias("line"))
