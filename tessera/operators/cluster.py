"""Clustering in rounds with discard, compression and retained sets.

Points are (idx, f: array<double>). Clusters are summaries (cluster, n, sum, sumsq) with centroid and
population deviation derived; they are few and small, points stay distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored


def by_dimension(points: DataFrame, cluster: str) -> DataFrame:
    """(cluster, dim, n, sum, sumsq, mean, dev): one aggregate; ``cluster`` names the label column."""
    each = points.select(F.col(cluster).alias("cluster"), F.posexplode("f").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))
    out = each.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))
    mean = F.col("sum") / F.col("n")
    return out.withColumn("mean", mean).withColumn("dev", F.sqrt(F.greatest(F.lit(0.0), F.col("sumsq") / F.col("n") - mean * mean)))


def summaries(points: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, mean, dev) with arrays in the order of dimensions."""
    rows = by_dimension(points, cluster).groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "mean", "dev"))).alias("d"))
    return rows.select("cluster", "n", F.transform("d", lambda x: x["mean"]).alias("mean"), F.transform("d", lambda x: x["dev"]).alias("dev"))


def distance(f: Column, mean: Column, dev: Column) -> Column:
    """Mahalanobis distance for independent dimensions; those without spread are left out."""
    part = F.zip_with(F.zip_with(f, mean, lambda x, m: x - m), dev, lambda d, s: F.when(s > 0, (d / s) * (d / s)).otherwise(0.0))
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x))


def nearest(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(idx, cluster, distance) of the nearest cluster, the smallest of equals; no row without clusters.

    Clusters are tens of rows (their number is a parameter of the algorithm): they are one array beside
    each point, whose row is all that its nearest cluster takes."""
    all_ = clusters.agg(F.collect_list(F.struct("cluster", "mean", "dev")).alias("all"))
    each = points.select("idx", "f").crossJoin(F.broadcast(all_))  # one row
    best = F.array_min(F.transform("all", lambda c: F.struct(distance(F.col("f"), c["mean"], c["dev"]).alias("distance"), c["cluster"].alias("cluster"))))
    return each.select("idx", best.alias("b")).where("b is not null").select("idx", F.col("b.cluster").alias("cluster"), F.col("b.distance").alias("distance"))


def cluster_distances(clusters: DataFrame) -> DataFrame:
    """(a, b, distance), a < b: mean of the two one-sided distances of centroids."""
    x = clusters.select(F.col("cluster").alias("a"), F.col("mean").alias("ma"), F.col("dev").alias("da"))
    y = clusters.select(F.col("cluster").alias("b"), F.col("mean").alias("mb"), F.col("dev").alias("db"))
    d = (distance(F.col("ma"), F.col("mb"), F.col("db")) + distance(F.col("ma"), F.col("mb"), F.col("da"))) / 2
    return x.join(F.broadcast(y), F.col("a") < F.col("b")).select("a", "b", d.alias("distance"))


def assign(points: DataFrame, ds: DataFrame, cs: DataFrame, factor: float = 2.0) -> DataFrame:
    """(idx, kind, cluster): DS if the nearest discard cluster is within factor x sqrt(d), else CS by
    the same test, else RS (cluster -1). Statistics stand still within a round."""
    limit = F.lit(factor) * F.sqrt(F.size("f").cast("double"))
    near = lambda clusters, p: nearest(points, clusters).select("idx", F.col("cluster").alias(p), F.col("distance").alias(p + "_at"))
    out = points.join(near(ds, "d"), "idx", "left").join(near(cs, "c"), "idx", "left")
    d, c = F.col("d_at") < limit, F.col("c_at") < limit
    kind = F.when(d, "DS").when(c, "CS").otherwise("RS")
    return out.select("idx", kind.alias("kind"), F.when(d, F.col("d")).when(c, F.col("c")).otherwise(F.lit(-1)).alias("cluster"))


class _Summary:
    """A cluster's running sums on the driver."""

    def __init__(self, n: int, total: np.ndarray, squares: np.ndarray):
        self.n, self.total, self.squares = n, total, squares

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def dev(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.squares / self.n - self.mean**2))

    def add(self, other: _Summary) -> None:
        self.n, self.total, self.squares = self.n + other.n, self.total + other.total, self.squares + other.squares

    def far(self, other: _Summary) -> float:
        def one(s: np.ndarray) -> float:
            ok = s > 0
            return float(np.sqrt((((self.mean - other.mean)[ok] / s[ok]) ** 2).sum()))

        return (one(self.dev) + one(other.dev)) / 2


def _kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(idx, f, k) labels; fewer points than clusters make each a cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    if n <= k or n < 2:
        return points.select("idx", "f", F.col("idx").alias("k"))
    model = KMeans(k=max(2, k), seed=seed, featuresCol="v", predictionCol="k").fit(points.withColumn("v", array_to_vector("f")))
    return model.transform(points.withColumn("v", array_to_vector("f"))).select("idx", "f", F.col("k").cast("long").alias("k"))


def _sums(labelled: DataFrame, key: str) -> dict[int, _Summary]:
    out: dict[int, tuple[int, dict, dict]] = {}
    for r in by_dimension(labelled, key).collect():  # clusters x dimensions rows
        own = out.setdefault(r.cluster, (r.n, {}, {}))
        own[1][r.dim], own[2][r.dim] = r["sum"], r.sumsq
    return {c: _Summary(n, *(np.array([s[i] for i in sorted(s)]) for s in (a, b))) for c, (n, a, b) in out.items()}


def _frame(spark, clusters: dict[int, _Summary]) -> DataFrame:
    rows = [(int(c), s.mean.tolist(), s.dev.tolist()) for c, s in clusters.items()]
    return spark.createDataFrame(rows, "cluster long, mean array<double>, dev array<double>")


def bfr(points: DataFrame, k: int, rounds: int = 5, spread: int = 5, factor: float = 2.0, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rounds table, final labels): round, n_ds, n_cs_clusters, n_cs, n_rs; idx, cluster (-1: outlier).

    Points arrive in ``rounds`` hash chunks. The first round runs k-means with spread x k clusters,
    sets singletons aside, and clusters the rest into the k discard clusters; each later round
    assigns points by ``assign``, clusters the retained set and merges near compression clusters. At the
    end compression clusters within reach join their nearest discard cluster.
    """
    spark = points.sparkSession
    points = stored(points.select("idx", "f").withColumn("chunk", F.pmod(F.xxhash64("idx"), F.lit(rounds))), "points")
    reach = factor * float(np.sqrt(len(points.head().f))) if points.limit(1).count() else 0.0
    ds: dict[int, _Summary] = {}
    cs: dict[int, _Summary] = {}
    labels = None  # idx, f, kind, cluster
    report, fresh = [], 1_000_000
    for i in range(rounds):
        new = points.where(F.col("chunk") == i).select("idx", "f")
        if i == 0:
            first = stored(_kmeans(new, spread * k, seed), "first")
            single = first.groupBy("k").agg(F.count("*").alias("n")).where("n = 1").select("k")
            rs = stored(first.join(single, "k", "left_semi").select("idx", "f"), "rs")
            named = stored(_kmeans(first.join(single, "k", "left_anti").select("idx", "f"), k, seed), "ds")
            ds = _sums(named, "k")
            labels = named.select("idx", "f", F.lit("DS").alias("kind"), F.col("k").alias("cluster"))
        else:
            got = stored(new.join(assign(new, _frame(spark, ds), _frame(spark, cs), factor), "idx"), "got")
            for kind, own in (("DS", ds), ("CS", cs)):
                for c, s in _sums(got.where(F.col("kind") == kind), "cluster").items():
                    own[c].add(s)
            labels = labels.union(got.where("kind <> 'RS'").select("idx", "f", "kind", "cluster"))
            rs = stored(rs.union(got.where("kind = 'RS'").select("idx", "f")), "rs")
        n = rs.count()
        if n > 1:
            part = stored(_kmeans(rs, n // 2 + 1 if i == 0 else min(spread * k, n // 2 + 1), seed), "part")
            many = part.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
            grown = stored(part.join(many, "k", "left_semi").withColumn("cluster", F.col("k") + fresh), "grown")
            cs.update(_sums(grown, "cluster"))
            labels = labels.union(grown.select("idx", "f", F.lit("CS").alias("kind"), "cluster"))
            rs = stored(part.join(many, "k", "left_anti").select("idx", "f"), "rs")
            fresh += 1_000_000
        moved: dict[int, int] = {}
        for c in sorted(cs):  # near compression clusters become one
            near = min(((cs[c].far(cs[o]), o) for o in cs if o < c), default=(reach, 0))
            if near[0] < reach:
                cs[near[1]].add(cs.pop(c))
                moved[c] = near[1]
        if i == rounds - 1:
            for c in sorted(cs):
                near = min(((cs[c].far(d), o) for o, d in ds.items()), default=(reach, 0))
                if near[0] < reach:
                    ds[near[1]].add(cs.pop(c))
                    moved[c] = near[1]
        for c in moved:  # a cluster that joined one which then joined another
            while moved[c] in moved:
                moved[c] = moved[moved[c]]
        if moved:
            table = spark.createDataFrame(sorted(moved.items()), "cluster long, to long")
            joined = labels.join(F.broadcast(table), "cluster", "left")
            in_ds = F.col("to").isin([*ds]) if ds else F.lit(False)
            labels = joined.select("idx", "f", F.when(in_ds, "DS").otherwise(F.col("kind")).alias("kind"), F.coalesce("to", "cluster").alias("cluster"))
        labels = stored(labels, "labels")
        report.append((i + 1, sum(s.n for s in ds.values()), len(cs), sum(s.n for s in cs.values()), rs.count()))
    table = spark.createDataFrame(report, "round long, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    out = points.join(labels.where("kind = 'DS'").select("idx", "cluster"), "idx", "left").select("idx", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return table, out
