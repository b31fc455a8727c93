"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, text string, date string"
BUSINESS = "business_id string, city string, stars double, review_count bigint, attributes map<string,string>"
USER = "user_id string, review_count bigint, average_stars double"
BASKET = "user_id string, business_id string"
RATING = "user_id string, business_id string, stars double"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Lines as ``value``; ``min_partitions`` spreads a small file over at least so many tasks."""
    out = spark.read.text(path)
    return out.repartition(min_partitions) if min_partitions else out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Quoted or plain CSV; ids stay strings, so leading zeros survive."""
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').csv(path)


def transactions(spark: SparkSession, path: str, columns: int = 9) -> DataFrame:
    """(tx, product) from positions 0 (date m/d/yyyy), 1 (customer), 5 (product): the key is
    ``m/d/yy-customer``; numbers lose leading zeros; rows with unreadable numbers are dropped."""
    raw = csv(spark, path, ", ".join(f"c{i} string" for i in range(columns)))
    part = F.split("c0", "/")
    day = F.concat_ws("/", part[0], part[1], F.substring(part[2], -2, 2))
    out = raw.select(F.concat_ws("-", day, F.expr("cast(try_cast(c1 as bigint) as string)")).alias("tx"), F.expr("try_cast(c5 as bigint)").alias("product"), F.expr("try_cast(c1 as bigint)").alias("c"))
    return out.where("product is not null and c is not null").select("tx", "product")


def points(spark: SparkSession, path: str) -> DataFrame:
    """(idx, cluster, f) from headerless lines ``index,cluster,f1,...,fd``."""
    part = F.split("value", ",")
    return spark.read.text(path).select(part[0].cast("long").alias("idx"), part[1].cast("int").alias("cluster"), F.transform(F.slice(part, F.lit(3), F.size(part) - 2), lambda x: x.cast("double")).alias("f"))


def stream_ids(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Streaming lines of ids, ``max_files`` files a batch."""
    return spark.readStream.schema("user_id string").option("maxFilesPerTrigger", max_files).csv(path)


def simulated_draws(ids: DataFrame, size: int, batches: int, seed: int = 553) -> DataFrame:
    """(seq, batch, user_id): ``size`` draws with replacement from ``ids`` (user_id, pos 0..n-1) a batch."""
    n = ids.count()
    seq = ids.sparkSession.range(size * batches).withColumnRenamed("id", "seq")
    drawn = seq.select("seq", F.floor(F.col("seq") / size).alias("batch"), F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(max(n, 1))).alias("pos"))
    return drawn.join(ids, "pos").select("seq", "batch", "user_id")
