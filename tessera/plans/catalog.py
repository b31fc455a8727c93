"""Named queries of the engine over the warehouse tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, folded
from ..functions.ids import dense_ids
from ..functions.storage import run_path, stored
from ..operators import cluster, graph, itemsets, recommend, similarity, sketches, stats
from ..sources import readers, views, writers
from ..sources.readers import parquet
from .oracles import SQL as SQL

YEAR, SUPPORT, BATCH = 1998, 80, 300
HASHES, ROWS = 100, 4
SLOTS = [0, 20, 40, 60, 80]
THRESHOLD = 7


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def joined(df: DataFrame, col: str = "items") -> DataFrame:
    return df.withColumn(col, F.array_join(F.col(col), ","))


def levels(s: SparkSession, d: str, kind: str, size: int) -> DataFrame:
    out = itemsets.apriori(views.basket_items(s, d), SUPPORT, most=size)
    cols = ["items", "n"] if kind == "frequent" else ["items"]
    return joined(out.where((F.col("kind") == kind) & (F.col("size") == size)).select(*cols))


def _baskets(df: DataFrame) -> DataFrame:
    return df.groupBy("basket").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))


def _transposed(df: DataFrame) -> DataFrame:
    own = itemsets.transposed(df)
    return own.groupBy("basket").agg(F.count("*").alias("n_items"), F.min("item").alias("first"), F.max("item").alias("last"))


def tx_baskets(s: SparkSession, d: str) -> DataFrame:
    o, li = parquet(s, d, "orders"), parquet(s, d, "lineitem")
    key = F.concat_ws("-", F.date_format("o_orderdate", "M/d/yy"), F.col("o_custkey").cast("string"))
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(key.alias("tx")).agg(F.count_distinct("l_partkey").alias("n_items"))


def signatures(s: SparkSession, d: str) -> DataFrame:
    return similarity.signatures(views.token_sets(s, d), HASHES)


def pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.candidates(similarity.bands(signatures(s, d), ROWS))


def attributes(s: SparkSession, d: str) -> DataFrame:
    price = F.floor(F.col("s_acctbal") / 2500).cast("string")
    return parquet(s, d, "supplier").select(F.col("s_suppkey").alias("item"), F.create_map(F.lit("price_range"), price).alias("attributes"))


def matrices(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train, test = views.split(s, d)
    users, items = recommend.user_features(train), recommend.item_features(train, attributes(s, d))
    return recommend.feature_matrix(train, users, items), recommend.feature_matrix(test, users, items)


def model(s: SparkSession, d: str) -> DataFrame:
    return recommend.model_predictions(*matrices(s, d))


def kept_users(s: SparkSession, d: str) -> DataFrame:
    """``views.user_lists``, computed once for the steps that read it again."""
    return stored(views.user_lists(s, d), "users", free=True)


def predicted(s: SparkSession, d: str) -> DataFrame:
    """Estimates of the distinct test pairs."""
    return recommend.estimates(recommend.distinct_pairs(kept_users(s, d)))


def errors(s: SparkSession, d: str) -> DataFrame:
    return recommend.errors_of(recommend.estimates(kept_users(s, d)))


def blended(s: SparkSession, d: str) -> DataFrame:
    users = kept_users(s, d)
    items = recommend.Items(users)
    own = recommend.estimates(recommend.distinct_pairs(users), items=items)
    train, test = recommend.rating_features(users, items, attributes(s, d), own)
    return recommend.hybrid_of(recommend.modelled(train, test), F.col("prediction"))


def csv_file(s: SparkSession, d: str) -> DataFrame:
    """Suppliers through a CSV file with a header; names are quoted text."""
    path = run_path(s, "suppliers")
    name = F.concat(F.lit('a "quoted", name of '), "s_name")
    writers.csv(parquet(s, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("id"), name.alias("name"), "s_nationkey"), path)
    return readers.csv(s, path, "id string, name string, nation bigint")


def json_file(s: SparkSession, d: str) -> DataFrame:
    path = run_path(s, "events")
    writers.json_object(parquet(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), path)
    return readers.json_lines(s, path, "event_id bigint, k bigint")


def text_file(s: SparkSession, d: str) -> DataFrame:
    """Words of the lines of a text file, spread over four tasks at least."""
    path = run_path(s, "names")
    writers.text(parquet(s, d, "part").select(F.regexp_replace("p_name", "[\r\n]", " ").alias("value")), path)
    words = readers.text(s, path, 4).select(F.explode(F.split("value", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def transactions_file(s: SparkSession, d: str) -> DataFrame:
    """Transaction keys from a CSV file by position; customers and products have leading zeros there."""
    path = run_path(s, "transactions")
    o, li = parquet(s, d, "orders"), parquet(s, d, "lineitem")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    padded = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    own = {0: F.date_format("o_orderdate", "M/d/yyyy"), 1: padded("o_custkey"), 5: padded("l_partkey")}
    writers.csv(rows.select(*[own.get(i, F.lit("x")).alias(f"c{i}") for i in range(9)]), path)
    return readers.transactions(s, path).groupBy("tx").agg(F.count_distinct("product").alias("n_items"))


def points_file(s: SparkSession, d: str) -> DataFrame:
    path = run_path(s, "points")
    p = views.points(s, d)
    p.select(F.concat_ws(",", "idx", "label", F.array_join(F.transform("f", lambda x: x.cast("string")), ",")).alias("value")).write.text(path)
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return readers.points(s, path).select("idx", F.col("cluster").cast("long").alias("cluster"), F.size("f").cast("long").alias("dims"), F.round(total, 4).alias("total"))


def key_partitions(s: SparkSession, d: str) -> DataFrame:
    """Rows of each item and the partitions that hold them, after dealing by item."""
    dealt = stats.repartitioned(views.reviews(s, d).select("item"), 5, "item").withColumn("at", F.spark_partition_id())
    return dealt.groupBy("item").agg(F.count("*").alias("n_items"), F.count_distinct("at").alias("partitions"))


def edges(s: SparkSession, d: str) -> DataFrame:
    return graph.build(views.purchases(s, d), THRESHOLD)


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = views.points(s, d)
    c = cluster.summaries(p, "label")
    return p, c.where("cluster < 5"), c.where("cluster >= 5")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "review_counts": lambda s, d: stats.summary(views.reviews(s, d), YEAR),
    "reviews_in_year": lambda s, d: views.reviews(s, d).where(F.year("date") == YEAR).agg(F.count("*").alias("n")),
    "distinct_users": lambda s, d: views.reviews(s, d).agg(F.count_distinct("user").alias("n")),
    "distinct_items": lambda s, d: views.reviews(s, d).agg(F.count_distinct("item").alias("n")),
    "top10_users": lambda s, d: stats.top_k(views.reviews(s, d), "user"),
    "top10_items": lambda s, d: stats.top_k(views.reviews(s, d), "item"),
    "city_avg_stars": lambda s, d: rounded(stats.city_average(views.reviews(s, d), views.cities(s, d)), "stars"),
    "city_top10": lambda s, d: rounded(stats.best_cities(stats.city_average(views.reviews(s, d), views.cities(s, d))), "stars"),
    "partition_report": lambda s, d: stats.chunk_report(views.reviews(s, d), "item", 10),
    "json_props": lambda s, d: parquet(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "csv_file": csv_file,
    "json_file": json_file,
    "text_file": text_file,
    "transactions_file": transactions_file,
    "points_file": points_file,
    "key_partitions": key_partitions,
    "folded_names": lambda s, d: parquet(s, d, "customer").select("c_custkey", folded(F.col("c_name"), PRIME).alias("h")),
    "dense_ids": lambda s, d: dense_ids(parquet(s, d, "customer"), "c_name"),
    "tx_baskets": tx_baskets,
    "basket_case1": lambda s, d: _baskets(views.basket_items(s, d)),
    "basket_case2": lambda s, d: _transposed(views.basket_items(s, d)),
    "basket_filtered": lambda s, d: _baskets(itemsets.larger_than(views.basket_items(s, d), 3)),
    "son_candidates_1": lambda s, d: itemsets.son_candidates(views.basket_items(s, d), SUPPORT),
    "freq_1": lambda s, d: joined(itemsets.frequent_items(views.basket_items(s, d), SUPPORT)),
    "cand_2": lambda s, d: levels(s, d, "candidate", 2),
    "freq_2": lambda s, d: levels(s, d, "frequent", 2),
    "cand_3": lambda s, d: levels(s, d, "candidate", 3),
    "freq_3": lambda s, d: levels(s, d, "frequent", 3),
    "minhash_signatures": lambda s, d: similarity.exploded(signatures(s, d)),
    "lsh_bands": lambda s, d: similarity.bands(signatures(s, d), ROWS),
    "lsh_candidates": pairs,
    "similar_pairs": lambda s, d: rounded(similarity.compared(views.token_lists(s, d), pairs(s, d), 0.5), "similarity"),
    "user_avg": lambda s, d: rounded(recommend.averages(views.split(s, d)[0], "user"), "avg_stars"),
    "item_avg": lambda s, d: rounded(recommend.averages(views.split(s, d)[0], "item"), "avg_stars"),
    "cold_start": lambda s, d: rounded(recommend.cold_start(*views.split(s, d)), "prediction"),
    "pearson_pairs": lambda s, d: rounded(recommend.pearson_of(kept_users(s, d)), "similarity"),
    "top3_neighbours": lambda s, d: rounded(recommend.nearest_of(kept_users(s, d)).drop("rank"), "similarity"),
    "cf_predictions": lambda s, d: rounded(predicted(s, d).select("user", "item", F.col("cf").alias("prediction")), "prediction"),
    "user_features": lambda s, d: rounded(recommend.user_features(views.split(s, d)[0]), "user_stars"),
    "item_features": lambda s, d: rounded(recommend.item_features(views.split(s, d)[0], attributes(s, d)), "item_stars"),
    "feature_matrix": lambda s, d: rounded(matrices(s, d)[1], "user_count", "user_stars", "item_count", "item_stars"),
    "model_predictions": lambda s, d: rounded(model(s, d), "prediction"),
    "hybrid_predictions": lambda s, d: rounded(blended(s, d), "prediction"),
    "means_blend": lambda s, d: rounded(recommend.hybrid_of(predicted(s, d), recommend.means_model()), "prediction"),
    "support_blend": lambda s, d: rounded(recommend.support_hybrid_of(predicted(s, d), recommend.means_model()), "prediction"),
    "rmse": lambda s, d: rounded(recommend.rmse_of(errors(s, d)), "rmse"),
    "error_histogram": lambda s, d: recommend.histogram_of(errors(s, d)),
    "bloom_fpr": lambda s, d: sketches.bloom_fpr(views.stream(s, d, BATCH), bits=9973),
    "fm_estimate": lambda s, d: sketches.fm_estimate(views.stream(s, d, BATCH)),
    "exact_distinct": lambda s, d: sketches.exact_distinct(views.stream(s, d, BATCH)),
    "reservoir_sample": lambda s, d: sketches.reservoir(views.stream(s, d, BATCH), 100, SLOTS),
    "reservoir_table": lambda s, d: writers.reservoir_rows(sketches.reservoir(views.stream(s, d, BATCH), 100, SLOTS), SLOTS),
    "window_distinct": lambda s, d: sketches.window_distinct(parquet(s, d, "events")),
    "graph_edges": edges,
    "graph_vertices": lambda s, d: graph.vertices(edges(s, d)),
    "connected_components": lambda s, d: graph.connected_components(edges(s, d)),
    "label_propagation": lambda s, d: graph.label_propagation(edges(s, d)),
    "communities": lambda s, d: graph.communities(graph.connected_components(edges(s, d)), "component"),
    "community_lines": lambda s, d: writers.community_lines(graph.communities(graph.connected_components(edges(s, d)), "component")),
    "edge_betweenness": lambda s, d: rounded(graph.betweenness(edges(s, d)), "betweenness"),
    "modularity": lambda s, d: rounded(graph.modularity(e := edges(s, d), graph.connected_components(e)), "modularity"),
    "gn_communities": lambda s, d: graph.communities(graph.divided(edges(s, d)), "component"),
    "cluster_summary": lambda s, d: rounded(cluster.by_dimension(views.points(s, d), "label"), "sum", "sumsq", "mean", "dev", places=4),
    "point_mahalanobis": lambda s, d: rounded(cluster.nearest(p := views.points(s, d), cluster.summaries(p, "label")), "distance", places=4),
    "cluster_mahalanobis": lambda s, d: rounded(cluster.cluster_distances(cluster.summaries(views.points(s, d), "label")), "distance", places=4),
    "ds_cs_rs_assign": lambda s, d: cluster.assign(*halves(s, d), factor=1.0),
    "bfr_rounds": lambda s, d: cluster.bfr(views.points(s, d), 10)[0],
    "bfr_clusters": lambda s, d: cluster.bfr(views.points(s, d), 10)[1],
}
