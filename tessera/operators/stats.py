"""Counts, top-k, averages and partition reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seconds(run: Callable[[], object]) -> float:
    """Wall time of an action."""
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def summary(reviews: DataFrame, year: int) -> DataFrame:
    """One row: reviews, reviews of a year, users and items, in one pass."""
    return reviews.agg(
        F.count("*").alias("n_review"), F.count_if(F.year("date") == year).alias("n_review_year"),
        F.count_distinct("user").alias("n_user"), F.count_distinct("item").alias("n_item"),
    )


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys by (-count, key)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def city_average(reviews: DataFrame, cities: DataFrame) -> DataFrame:
    """Mean stars of each city; sums are whole numbers and divide last. Reviews are pre-aggregated
    per item, so the join moves one row an item."""
    per_item = reviews.groupBy("item").agg(F.sum("stars").alias("s"), F.count("*").alias("n"))
    return per_item.join(cities, "item").groupBy("city").agg((F.sum("s") / F.sum("n")).alias("stars"))


def best_cities(averages: DataFrame, k: int = 10) -> DataFrame:
    return averages.orderBy(F.desc("stars"), "city").limit(k)


def chunk_report(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows in each of n key chunks."""
    return df.groupBy(F.pmod(F.col(key), F.lit(n)).alias("chunk")).agg(F.count("*").alias("n_items"))


def partition_report(df: DataFrame) -> DataFrame:
    """Rows in each physical partition of a plan (empty ones have no row)."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def repartitioned(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.repartition(n, key)
