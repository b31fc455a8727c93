"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept. All but
the last return the columns of ``documents``; the last returns the mix, a row for each time that a
document is drawn. Each stage's result is a table in the shared folder, which the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.language_id import fit, identify
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.substring_dedup import substring_dedup

#: Words of a repeated passage that substring dedup cuts.
PASSAGE_WORDS = 50
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language that the text is in; those without any (``und``) go: null, empty
    and letterless texts. Null ids and sources stay, repeated rows go or stay alike, extra columns are
    left out, ties go to the first language by name; an empty table, or one that teaches no language,
    gives an empty one."""
    known = docs.drop("lang_pred", "score")
    out = identify(known, fit(known)).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Rows with a null doc_id stay; of rows that repeat doc_id and text, one stays. Where a doc_id has
    several texts each is judged by itself, so that none goes for another's sake.
    """
    docs = docs.select(COLUMNS)
    rows, ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).head()
    docs = docs.withColumn("_node", F.col("doc_id"))
    if rows != ids:  # a number for each doc_id and text, in the order of the doc_ids
        named = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text")
        named = named.withColumn("_node", F.monotonically_increasing_id())
        docs = stored(named.unionByName(docs.where("doc_id is null")), "nodes")
    marked = near_duplicates(docs.select(F.col("_node").alias("doc_id"), "text"), shingle_words=5, percent=80)
    gone = marked.where("not kept").select(F.col("doc_id").alias("_node")).distinct()
    return docs.join(gone, "_node", "left_anti").select(COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more go from all documents but the first that has them.

    Every row stays, a null text as null, an empty one as empty. Rows with a null doc_id lose nothing;
    rows that repeat a doc_id take nothing from each other. Extra columns are left out.
    """
    out = substring_dedup(docs.select(COLUMNS), min_words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go.

    Null and empty texts hold none and stay, as do all rows if the benchmark is empty or has null texts
    alone; repeated rows go or stay alike, whatever their doc_id. Extra columns are left out.
    """
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is drawn, with its position.

    A null source is the source ''; documents without words have nothing to draw; repeated rows are
    drawn each; an empty table gives an empty mix.
    """
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", cut_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Suffix automata, alignment and the bisection have no SQL form; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
