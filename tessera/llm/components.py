"""Connected components of an edge table, by minimum label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a key that meet in one cell, and the most keys that can have cells of their own.
CELL, SMALL = 512, 100_000


def hottest(load: DataFrame, rows: int, *key: str) -> DataFrame | None:
    """(key, cells) of the keys that have more of a table's ``rows`` than a cell takes, None if there are
    none; ``load`` has the rows ``c`` of each key.

    A cell takes one SMALL-th of all rows, if that is more than CELL: fewer than SMALL keys can have
    more, so the result may be broadcast at any size.
    """
    cell = max(CELL, -(-rows // SMALL))
    load = load.where(F.col("c") > cell)
    hot = stored(load.select(*key, F.ceil(F.col("c") / cell).cast("int").alias("cells")), "hot")
    return hot if hot.limit(1).count() else None


def hot_keys(many: DataFrame, *key: str) -> DataFrame | None:
    """``hottest`` of the table ``many``."""
    return hottest(many.groupBy(*key).agg(F.count("*").alias("c")), many.count(), *key)


def joined(many: DataFrame, one: DataFrame, key: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key at most. Rows of a hot key are dealt
    over its cells by the column ``by``, and its row of ``one`` is copied to every cell."""
    if hot is None:
        return many.join(one.hint("merge"), key, how)
    hot = F.broadcast(hot)
    cell = F.coalesce(F.pmod(F.xxhash64(by), F.col("cells")).cast("int"), F.lit(0))
    many = many.join(hot, key, "left").withColumn("cell", cell).drop("cells")
    one = one.join(hot, key, "left").withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))).drop("cells")
    return many.join(one.hint("merge"), [*key, "cell"], how).drop("cell")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round is a join and a partial aggregate over the edges, then one jump along labels, so
    a star of any size costs one row per edge and the rounds grow with the logarithm of a path's
    length. Hubs and large components are dealt over cells. Every round is a table in the shared folder. Null ends, loops and repeated edges are
    harmless; an empty edge table gives an empty result.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = both.select(F.col(a).alias("s"), F.col(b).alias("d")).distinct()
    both = stored(both.union(both.select("d", "s")), "links")
    labels = stored(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.first("s")).alias("component")), "labels")
    hubs = hot_keys(both, "d")
    while True:
        near = joined(both, labels.withColumnRenamed("node", "d"), ["d"], hubs, "s").groupBy("s").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.s).select(
            "node", F.least("component", "near").alias("to"), F.col("component").alias("was")
        )
        step = stored(step, "step")
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = joined(step, jump, ["to"], hot_keys(step, "to"), "node")
        new = stored(new.select("node", F.least("to", "far").alias("component"), "was"), "labels")
        labels = new.select("node", "component")
        if not new.where("component < was").limit(1).count():
            return labels


def merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """``comps`` (node, component) after further edges ``more`` (a, b), by the components they join."""
    if not more.limit(1).count():
        return comps
    at = lambda end: comps.select(F.col("node").alias(end), F.col("component").alias("c" + end))
    ends = more.join(at("a"), "a", "left").join(at("b"), "b", "left")
    over = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    lone = over.select("node", F.col("node").alias("component")).join(comps.select("node"), "node", "left_anti")
    over = over.select(F.col("node").alias("component"), F.col("component").alias("new"))
    every = joined(comps.unionByName(lone), over, ["component"], hot_keys(comps, "component"), "node", "left")
    return stored(every.select("node", F.coalesce("new", "component").alias("component")), "merged")
