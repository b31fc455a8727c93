"""Command line: ``python -m tessera.cli COMMAND ARG...``; each command reads files and writes a result.

    reviews     REVIEWS OUT [YEAR]                  summary with top-10 users and businesses
    partitions  REVIEWS OUT N                       rows by partition and seconds of a top 10, as read and by business
    cities      REVIEWS BUSINESSES OUT [OUT_TIMES]  mean stars by city, best first; seconds of two ways to the best ten
    itemsets    CASE SUPPORT BASKETS OUT            frequent itemsets; case 1: users' items, 2: items' users
    shopping    MORE_THAN SUPPORT TRANSACTIONS OUT [STRICT]  itemsets of transactions with more than so many products
    similar     RATINGS OUT [LEAST]                 similar businesses by MinHash
    cf          TRAIN TEST OUT                      item-based predictions
    model       FOLDER TEST OUT                     boosted trees on user and business features
    hybrid      FOLDER TEST OUT [ALPHA]             blend of both
    labels      THRESHOLD PAIRS OUT                 communities by label propagation
    divide      THRESHOLD PAIRS OUT_EDGES OUT       edge betweenness, and communities by modularity
    bloom       USERS SIZE BATCHES OUT              false-positive rate by batch
    distinct    USERS SIZE BATCHES OUT              true and estimated distinct users by batch
    reservoir   USERS SIZE BATCHES OUT              slots of a fixed-size sample by batch
    bfr         POINTS K OUT_ROUNDS OUT             clustering in rounds
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cluster, graph, itemsets, recommend, similarity, sketches, stats
from .functions.ids import dense_ids
from .session import get_session
from .sources import readers, writers

SLOTS = [0, 20, 40, 60, 80]


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    r = readers.json_lines(spark, path, readers.REVIEW)
    return r.select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), "stars", F.to_date(F.substring("date", 1, 10)).alias("date"))


def reviews(spark, path, out, year=2018):
    r = _reviews(spark, path)

    def top(key: str, name: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(key).alias("id"))))
        return stats.top_k(r, key).agg(F.transform(own, lambda x: F.struct(x["id"].alias("id"), (-x["n"]).alias("n"))).alias(name))

    cols = [top("user", "top10_user"), top("item", "top10_business")]
    writers.json_object(stats.summary(r, int(year)).crossJoin(cols[0]).crossJoin(cols[1]), out)  # one row each


def partitions(spark, path, out, n):
    r = _reviews(spark, path).select("item")
    plans = {"default": r, "customized": stats.repartitioned(r, int(n), "item")}
    own = [stats.partition_report(df).withColumn("kind", F.lit(kind)) for kind, df in plans.items()]
    took = [(kind, stats.seconds(lambda df=df: stats.top_k(df, "item").collect())) for kind, df in plans.items()]
    own = own[0].unionByName(own[1]).groupBy("kind").agg(F.count("*").alias("n_partition"), F.sort_array(F.collect_list("n_items")).alias("n_items"))
    writers.json_object(own.join(spark.createDataFrame(took, "kind string, exe_time double"), "kind"), out)


def cities(spark, path, businesses, out, times=None):
    own = readers.json_lines(spark, businesses, readers.BUSINESS).select(F.col("business_id").alias("item"), "city")
    means = stats.city_average(_reviews(spark, path), own)
    writers.csv(means.orderBy(F.desc("stars"), "city"), out)
    if times:  # a full sort, of which ten rows are read, against a top ten that each partition cuts first
        whole = means.orderBy(F.desc("stars"), "city").withColumn("n", F.monotonically_increasing_id())
        m1 = stats.seconds(lambda: next(whole.toLocalIterator(), None))
        m2 = stats.seconds(lambda: stats.best_cities(means).collect())
        reason = "m1 sorts all cities by ranges, in two passes; m2 keeps ten rows of each partition and merges those."
        writers.json_object(spark.createDataFrame([(m1, m2, reason)], "m1 double, m2 double, reason string"), times)


def _report(baskets: DataFrame, support: int, out: str, blank: bool = False, strict: bool = False) -> None:
    writers.text(writers.itemset_lines(itemsets.report(itemsets.apriori(baskets, support, strict=strict)), blank), out)


def basket_file(spark, case, support, path, out):
    b = readers.csv(spark, path, readers.BASKET).select(F.col("user_id").alias("basket"), F.col("business_id").alias("item")).distinct()
    _report(itemsets.transposed(b) if str(case) == "2" else b, int(support), out)


def shopping(spark, more, support, path, out, strict=""):
    b = readers.transactions(spark, path).select(F.col("tx").alias("basket"), F.col("product").alias("item")).distinct()
    _report(itemsets.larger_than(b, int(more)), int(support), out, blank=True, strict=bool(strict))


def _ratings(spark, path):
    r = readers.csv(spark, path, readers.RATING)
    return r.groupBy(F.col("user_id").alias("user"), F.col("business_id").alias("item")).agg(F.floor(F.avg("stars") + 0.5).cast("long").alias("stars"))


def similar(spark, path, out, least=0.5):
    sets = readers.csv(spark, path, readers.RATING).select(F.col("business_id").alias("doc"), F.col("user_id").alias("token")).distinct()
    pairs = similarity.candidates(similarity.bands(similarity.signatures(sets, 50), 2))
    found = similarity.jaccard(sets, pairs, float(least)).orderBy("a", "b")
    writers.csv(found.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), "similarity"), out)


def _predictions(df: DataFrame, out: str) -> None:
    writers.csv(df.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "prediction"), out)


def cf(spark, train, test, out):
    _predictions(recommend.cf_predictions(_ratings(spark, train), _ratings(spark, test)), out)


def _model(spark, folder, test):
    u = readers.json_lines(spark, f"{folder}/user.json", readers.USER).select(F.col("user_id").alias("user"), F.col("review_count").alias("user_count"), F.col("average_stars").alias("user_stars"))
    price = F.coalesce(F.expr("try_cast(try_element_at(attributes, 'RestaurantsPriceRange2') as bigint)"), F.lit(0))
    b = readers.json_lines(spark, f"{folder}/business.json", readers.BUSINESS)
    b = b.select(F.col("business_id").alias("item"), F.col("review_count").alias("item_count"), F.col("stars").alias("item_stars"), price.alias("price_range"))
    return recommend.model_predictions(*(recommend.feature_matrix(_ratings(spark, p), u, b) for p in (f"{folder}/train.csv", test)))


def model(spark, folder, test, out):
    _predictions(_model(spark, folder, test), out)


def hybrid(spark, folder, test, out, alpha=0.1):
    own = recommend.cf_predictions(_ratings(spark, f"{folder}/train.csv"), _ratings(spark, test))
    _predictions(recommend.hybrid(own, _model(spark, folder, test), float(alpha)), out)


def _graph(spark, threshold, path):
    """Edges between users as whole numbers, and the names of the numbers."""
    p = readers.csv(spark, path, readers.BASKET).select("user_id", F.col("business_id").alias("item")).distinct()
    edges = graph.build(p.withColumnRenamed("user_id", "user"), int(threshold))
    return edges, dense_ids(graph.vertices(edges).withColumnRenamed("vertex", "name"), "name")


def _numbered(edges, n):
    a, b = n.select(F.col("id").alias("a"), F.col("name").alias("u")), n.select(F.col("id").alias("b"), F.col("name").alias("v"))
    return n, edges.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _communities(labels: DataFrame, n: DataFrame, label: str, out: str) -> None:
    named = labels.join(n, labels.vertex == n.id).select(F.col("name").alias("vertex"), label)
    writers.text(writers.community_lines(graph.communities(named, label)), out)


def labels(spark, threshold, path, out):
    n, e = _numbered(*_graph(spark, threshold, path))
    _communities(graph.label_propagation(e), n, "label", out)


def divide(spark, threshold, path, out_edges, out):
    n, e = _numbered(*_graph(spark, threshold, path))
    a, b = n.select(F.col("id").alias("u"), F.col("name").alias("nu")), n.select(F.col("id").alias("v"), F.col("name").alias("nv"))
    scored = graph.betweenness(e).join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "betweenness")
    writers.text(writers.betweenness_lines(scored), out_edges)
    _communities(graph.divided(e), n, "component", out)


def _stream(spark, path, size, batches):
    ids = dense_ids(readers.text(spark, path).select(F.trim("value").alias("user_id")), "user_id", "pos")
    return readers.simulated_draws(ids, int(size), int(batches)).select("seq", "batch", F.col("user_id"), F.xxhash64("user_id").alias("user"))


def bloom(spark, path, size, batches, out):
    writers.csv(sketches.bloom_fpr(_stream(spark, path, size, batches)).orderBy("batch").select(F.col("batch").alias("Time"), F.col("fpr").alias("FPR")), out)


def distinct(spark, path, size, batches, out):
    got = sketches.fm_estimate(_stream(spark, path, size, batches)).orderBy("batch")
    writers.csv(got.select(F.col("batch").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation")), out)


def reservoir(spark, path, size, batches, out):
    own = _stream(spark, path, size, batches).withColumn("user", F.col("user_id"))
    writers.csv(writers.reservoir_rows(sketches.reservoir(own, 100, SLOTS), SLOTS), out)


def bfr(spark, path, k, out_rounds, out):
    rounds, got = cluster.bfr(readers.points(spark, path).select("idx", "f"), int(k))
    writers.text(writers.cluster_lines(rounds), out_rounds)
    writers.csv(got.orderBy("idx"), out)


COMMANDS = {f.__name__: f for f in (reviews, partitions, cities, shopping, similar, cf, model, hybrid, labels, divide, bloom, distinct, reservoir, bfr)} | {"itemsets": basket_file}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    spark = get_session("tessera " + args[0])
    print(f"Duration: {stats.seconds(lambda: COMMANDS[args[0]](spark, *args[1:])):.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
