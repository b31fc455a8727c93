"""Co-purchase graphs: construction, components, label propagation, betweenness, modularity and
division by the most central edges.

A graph is a table of edges (u, v), u < v. Iterations cut lineage through tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Edges up to which an adjacency list is sent to the tasks; larger graphs go level by level by joins.
SMALL_GRAPH = 2_000_000
#: Vertices x edge ends of a component up to which the driver scores it without a job.
SMALL_WORK = 2_000_000


def build(purchases: DataFrame, threshold: int) -> DataFrame:
    """(u, v, overlap) of users with ``threshold`` common items or more; users with fewer items are
    out before pairs are formed."""
    active = purchases.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select("user")
    own = purchases.join(active, "user", "left_semi")
    x, y = own.select("item", F.col("user").alias("u")), own.select("item", F.col("user").alias("v"))
    return x.join(y, "item").where("u < v").groupBy("u", "v").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select("v", "u"))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("u").alias("vertex")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, by minimum labels with pointer jumping."""
    links = stored(both_ways(edges), "links")
    labels = stored(links.groupBy(F.col("u").alias("vertex")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = links.join(labels, links.v == labels.vertex).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.vertex == near.u).select("vertex", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("vertex").alias("to"), F.col("component").alias("far"))
        new = stored(step.join(jump, "to").select("vertex", F.least("to", "far").alias("component"), "was"), "labels")
        labels = new.select("vertex", "component")
        if not new.where("component < was").limit(1).count():
            return labels


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(vertex, label): in every round each vertex takes its neighbours' most frequent label, the
    smallest of equals."""
    links = stored(both_ways(edges), "links")
    labels = links.select(F.col("u").alias("vertex")).distinct().withColumn("label", F.col("vertex"))
    for _ in range(rounds):
        votes = links.join(labels, links.v == labels.vertex).groupBy("u", "label").agg(F.count("*").alias("n"))
        best = votes.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("n"), "label"))).where("rank = 1")
        labels = stored(best.select(F.col("u").alias("vertex"), "label"), "labels")
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(size, members): sorted members joined by commas."""
    m = F.array_sort(F.collect_list("vertex"))
    return labels.groupBy(label).agg(m.alias("m")).select(F.size("m").cast("long").alias("size"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


def _credits(graph: dict[int, list[int]], roots: Iterable[int]) -> dict[tuple[int, int], float]:
    """Flow over each edge of the shortest paths from the given roots (breadth first, then backwards)."""
    credit: dict[tuple[int, int], float] = {}
    for root in roots:
        depth, paths, order, at = {root: 0}, {root: 1}, [root], 0
        while at < len(order):
            x = order[at]
            at += 1
            for y in graph[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        flow = dict.fromkeys(order, 1.0)
        for y in reversed(order[1:]):
            for x in graph[y]:
                if depth[x] == depth[y] - 1:
                    part = flow[y] * paths[x] / paths[y]
                    flow[x] += part
                    e = (x, y) if x < y else (y, x)
                    credit[e] = credit.get(e, 0.0) + part
    return credit


def _adjacency(edges: Iterable[tuple[int, int]]) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    return near


def _spread_credits(spark: SparkSession, graph: dict[int, list[int]], roots: DataFrame) -> DataFrame:
    """(u, v, betweenness) with the roots (vertex) dealt over the tasks."""
    sent = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = _credits(sent.value, batch["vertex"])
            if got:
                yield pd.DataFrame([(u, v, c) for (u, v), c in got.items()], columns=["u", "v", "c"])

    return roots.repartition("vertex").mapInPandas(run, "u long, v long, c double").groupBy("u", "v").agg((F.sum("c") / 2).alias("betweenness"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(u, v, betweenness): shortest paths through an edge, each path shared among equals, each pair
    of ends counted once. One breadth-first pass a root; roots are spread over the tasks."""
    edges = stored(edges.select("u", "v"), "edges")
    if edges.count() > SMALL_GRAPH:
        return _betweenness_by_joins(edges)
    graph = _adjacency((r.u, r.v) for r in edges.collect())  # bounded by SMALL_GRAPH
    return _spread_credits(edges.sparkSession, graph, vertices(edges))


def _betweenness_by_joins(edges: DataFrame) -> DataFrame:
    """The same from tables of distances and path counts: an edge on a shortest path from s to t
    carries paths(s, u) x paths(v, t) / paths(s, t)."""
    links = stored(both_ways(edges), "links")
    level = links.select(F.col("u").alias("s")).distinct().select("s", F.col("s").alias("t"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    seen = level = stored(level, "level")
    while True:
        step = level.join(links, level.t == links.u).groupBy("s", F.col("v").alias("t")).agg((F.first("d") + 1).alias("d"), F.sum("paths").alias("paths"))
        level = stored(step.join(seen.select("s", "t"), ["s", "t"], "left_anti"), "level")
        if not level.limit(1).count():
            break
        seen = stored(seen.union(level), "seen")
    a = seen.select("s", F.col("t").alias("x"), F.col("d").alias("d1"), F.col("paths").alias("p1"))
    b = seen.select(F.col("s").alias("y"), "t", F.col("d").alias("d2"), F.col("paths").alias("p2"))
    through = a.join(links.select(F.col("u").alias("x"), F.col("v").alias("y")), "x").join(b, "y").join(seen.select("s", "t", "d", "paths"), ["s", "t"]).where("d1 + d2 + 1 = d")
    return through.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg((F.sum(F.col("p1") * F.col("p2") / F.col("paths")) / 2).alias("betweenness"))


def modularity(edges: DataFrame, parts: DataFrame, label: str = "component") -> DataFrame:
    """One row: sum over pairs i < j of a community of (A_ij - k_i k_j / 2m) / 2m, by whole sums:
    pairs of degrees come from the squares of their sums."""
    degree = both_ways(edges).groupBy(F.col("u").alias("vertex")).agg(F.count("*").alias("k"))
    own = parts.select("vertex", F.col(label).alias("part"))
    per = degree.join(own, "vertex").groupBy("part").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    a, b = own.select(F.col("vertex").alias("u"), F.col("part").alias("pu")), own.select(F.col("vertex").alias("v"), F.col("part").alias("pv"))
    inside = edges.join(a, "u").join(b, "v").agg(F.count_if(F.col("pu") == F.col("pv")).alias("within"), F.count("*").alias("m"))
    pairs = per.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("kk"))
    two_m = 2 * F.col("m")
    return inside.crossJoin(pairs).select(((F.col("within") - F.col("kk") / two_m) / two_m).alias("modularity"))  # one row each


def _parts(graph: dict[int, list[int]], among: Iterable[int]) -> list[list[int]]:
    """Components of the given vertices, each sorted."""
    seen: set[int] = set()
    out = []
    for start in among:
        if start not in seen:
            seen.add(start)
            own = [start]
            for x in own:
                for y in graph[x]:
                    if y not in seen:
                        seen.add(y)
                        own.append(y)
            out.append(sorted(own))
    return out


def divided(edges: DataFrame) -> DataFrame:
    """(vertex, component) of the division with the largest modularity: all edges of the largest
    betweenness are cut together, again and again; the first of equals is kept.

    A cut changes shortest paths in its own component only, so only that is scored anew, by the tasks
    if it is large. Beyond SMALL_GRAPH edges every step is joins (``divided_by_joins``).
    """
    edges = stored(edges.select("u", "v"), "edges")
    if edges.count() > SMALL_GRAPH:
        return divided_by_joins(edges)
    spark = edges.sparkSession
    links = sorted((r.u, r.v) for r in edges.collect())  # bounded by SMALL_GRAPH
    graph = {v: sorted(n) for v, n in _adjacency(links).items()}
    degree, m = {v: len(n) for v, n in graph.items()}, len(links)

    def gain(part: list[int], where: dict[int, int]) -> float:
        """A part's share of the modularity: inner edges of the whole graph less those expected."""
        inner = sum(where[y] == where[part[0]] for x in part for y in original[x]) / 2
        s = sum(degree[x] for x in part)
        return (inner - (s * s - sum(degree[x] ** 2 for x in part)) / 2 / (2 * m)) / (2 * m)

    original = {v: list(n) for v, n in graph.items()}
    parts = {p[0]: p for p in _parts(graph, sorted(graph))}
    where = {x: k for k, p in parts.items() for x in p}
    gains = {k: gain(p, where) for k, p in parts.items()}
    scores: dict[tuple[int, int], float] = {}
    stale, best, kept = list(parts), None, dict(where)
    while True:
        q = sum(gains[k] for k in sorted(gains))
        if m and (best is None or q > best + 1e-12):
            best, kept = q, dict(where)
        for k in stale:
            own = parts[k]
            if len(own) * sum(len(graph[x]) for x in own) <= SMALL_WORK:
                got = {e: c / 2 for e, c in _credits(graph, own).items()}
            else:
                inside = {x: graph[x] for x in own}
                got = {(r.u, r.v): r.betweenness for r in _spread_credits(spark, inside, spark.createDataFrame([(x,) for x in own], "vertex long")).collect()}
            scores.update(got)
        if not scores:
            break
        top = max(scores.values())
        cut = [e for e, c in scores.items() if c >= top - 1e-9]
        touched = {where[u] for u, _ in cut}
        for u, v in cut:
            del scores[(u, v)]
            graph[u].remove(v)
            graph[v].remove(u)
        stale = []
        for k in sorted(touched):
            for p in _parts(graph, parts.pop(k)):
                parts[p[0]] = p
                where.update(dict.fromkeys(p, p[0]))
                stale.append(p[0])
            del gains[k]
        gains.update({k: gain(parts[k], where) for k in stale})
    return spark.createDataFrame(sorted(kept.items()), "vertex long, component long")


def divided_by_joins(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(vertex, component) of the division with the largest modularity: all edges of the largest
    betweenness are cut together, again and again; the first of equals is kept."""
    original = edges = stored(edges.select("u", "v"), "edges")
    best, kept, rounds = None, None, 0
    lone = stored(vertices(original), "vertices")
    while True:
        comps = connected_components(edges) if edges.limit(1).count() else lone.select("vertex", F.col("vertex").alias("component")).limit(0)
        parts = stored(lone.join(comps, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component")), "parts")
        q = modularity(original, parts).head()[0]
        if q is not None and (best is None or q > best + 1e-12):
            best, kept = q, parts
        rounds += 1
        if not edges.limit(1).count() or (most and rounds >= most):
            return kept if kept is not None else parts
        scored = stored(betweenness(edges), "scored")
        top = scored.agg(F.max("betweenness")).head()[0]
        edges = stored(scored.where(F.col("betweenness") < top - 1e-9).select("u", "v"), "edges")
