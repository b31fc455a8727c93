"""Canonical inputs of the mining operators over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recommend import grouped
from .readers import parquet


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """(order, user, item, stars, date): a line of an order is a user's review of its supplier."""
    o = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("date"))
    li = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("item"), F.ceil(F.col("l_quantity") / 10).cast("long").alias("stars"))
    return li.join(o, "order")


def rated(reviews: DataFrame) -> DataFrame:
    """(user, item, stars): one whole-star rating a pair, the mean of its reviews rounded half up."""
    return reviews.groupBy("user", "item").agg(rating())


def rating() -> Column:
    return F.floor(F.sum("stars") / F.count("*") + 0.5).cast("long").alias("stars")


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(train ratings, test pairs with truth): orders divisible by ten are held out; three kinds of
    cold pairs with unknown ids are part of the test."""
    r = reviews(spark, d)
    held = F.col("order") % 10 == 0
    test = rated(r.where(held))
    cold = test.where("item % 50 = 0").select((-F.col("user") - 1).alias("user"), "item", "stars")
    cold = cold.union(test.where("item % 50 = 1").select("user", (-F.col("item") - 1).alias("item"), "stars"))
    cold = cold.union(test.where("item % 50 = 2").select((-F.col("user") - 1).alias("user"), (-F.col("item") - 1).alias("item"), "stars"))
    return rated(r.where(~held)), test.union(cold)


def user_lists(spark: SparkSession, d: str) -> DataFrame:
    """(user, rated, asked): ``split`` with a user's ratings and test pairs as lists of (item, stars) in
    one row; reviews are joined once and dealt by user once."""
    rows = reviews(spark, d).select(F.greatest("user", -F.col("user") - 1).alias("home"), "item", "stars", (F.col("order") % 10 == 0).alias("held"), (F.col("user") < 0).alias("below"))
    rows = rows.repartition("home").select("*", F.when(F.col("below"), -F.col("home") - 1).otherwise(F.col("home")).alias("user"))  # a user and the cold one made of it
    item, part = F.col("item"), F.col("item") % 50
    own = F.struct("user", "item", F.col("held").cast("int").alias("kind"))
    cold = F.struct(F.when(part == 1, F.col("user")).otherwise(-F.col("user") - 1).alias("user"), F.when(part == 0, item).otherwise(-item - 1).alias("item"), (part + 2).cast("int").alias("kind"))
    rows = rows.select("home", "stars", F.inline(F.when(F.col("held") & part.isin(0, 1, 2), F.array(own, cold)).otherwise(F.array(own))))
    rows = rows.groupBy("home", "user", "item", "kind").agg(rating())
    return grouped(rows.select("home", "user", "item", "stars", (F.col("kind") > 0).alias("asked")), "home")


def cities(spark: SparkSession, d: str) -> DataFrame:
    """(item, city): the nation of a supplier."""
    s, n = parquet(spark, d, "supplier"), parquet(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("item"), F.col("n_name").alias("city"))


def basket_items(spark: SparkSession, d: str) -> DataFrame:
    """(basket, item): distinct brands of an order."""
    li, p = parquet(spark, d, "lineitem"), parquet(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """(user, item): distinct parts that a customer ordered."""
    o, li = parquet(spark, d, "orders"), parquet(spark, d, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()


def stream(spark: SparkSession, d: str, size: int = 300) -> DataFrame:
    """(seq, batch, user): orders by key as a stream in count windows of ``size``."""
    o = parquet(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.floor(F.col("o_orderkey") / size).alias("batch"), F.col("o_custkey").alias("user"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """(idx, label, f): embeddings as points."""
    e = parquet(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("f"))


def token_lists(spark: SparkSession, d: str) -> DataFrame:
    """(doc, tokens): distinct lower-cased tokens between white space of each document."""
    return parquet(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("tokens"))


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    """(doc, token): the tokens of ``token_lists``, a row each."""
    return token_lists(spark, d).select("doc", F.explode("tokens").alias("token"))
