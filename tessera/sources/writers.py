"""Sinks: JSON objects, CSV with a header, and the text reports of the miners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_object(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """A header and rows; a quote within a quoted field is doubled, as ``readers.csv`` reads it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def itemset_lines(report: DataFrame, blank: bool = False) -> DataFrame:
    """Lines of an itemset report in order: ``Candidates:``, a line a size, ``Frequent Itemsets:``;
    ``blank`` puts an empty line after each candidate line."""
    spark = report.sparkSession
    heads = spark.createDataFrame([(0, 0, "Candidates:"), (1, 0, "Frequent Itemsets:")], "part int, at int, value string")
    own = report.select((F.col("kind") == "frequent").cast("int").alias("part"), (F.col("size") * 2).cast("int").alias("at"), F.col("line").alias("value"))
    lines = heads.union(own)
    if blank:
        lines = lines.union(own.where("part = 0").select("part", F.col("at") + 1, F.lit("")))
    return lines.orderBy("part", "at").select("value")


def community_lines(communities: DataFrame) -> DataFrame:
    """``'a', 'b'`` a line, by size and members."""
    return communities.orderBy("size", "members").select(F.concat(F.lit("'"), F.regexp_replace("members", ",", "', '"), F.lit("'")).alias("value"))


def betweenness_lines(scored: DataFrame) -> DataFrame:
    """``('u', 'v'), x`` rounded to five places, most central first."""
    return scored.orderBy(F.desc("betweenness"), "u", "v").select(F.format_string("('%s', '%s'), %s", F.col("u").cast("string"), F.col("v").cast("string"), F.round("betweenness", 5).cast("string")).alias("value"))


def cluster_lines(rounds: DataFrame) -> DataFrame:
    return rounds.orderBy("round").select(F.format_string("Round %d: %d,%d,%d,%d", "round", "n_ds", "n_cs_clusters", "n_cs", "n_rs").alias("value"))


def reservoir_rows(sample: DataFrame, slots: list[int]) -> DataFrame:
    """(seqnum, 0_id, 20_id, ...) a batch."""
    return sample.groupBy("batch", F.col("n").alias("seqnum")).agg(*[F.max(F.when(F.col("slot") == s, F.col("user"))).alias(f"{s}_id") for s in slots]).orderBy("batch").drop("batch")


def text(lines: DataFrame, path: str) -> None:
    """Ordered lines in one file; reports are small results."""
    lines.coalesce(1).write.mode("overwrite").text(path)
