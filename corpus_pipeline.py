"""From raw documents to token ids: quality rules, line dedup, near duplicates, source mixing, pieces.

Each stage reads what the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.llm import jaccard, lines, mixing, pieces, quality
from casework.llm.scratch import shared_folder, stored
from casework.operators.shape import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_DOCS = 10
SHINGLE_WORDS, PERCENT = 5, 80
WEIGHTS, MOST_COPIES = (5, 2, 1), 3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the basic limits, or whose votes make them probably poor, go."""
    return quality.judge(docs).where("__kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in LEAST_DOCS documents or more go from all of them; n_chars follows the text."""
    out = lines.drop_common_lines(docs, LEAST_DOCS)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the smallest id stays; rows without id stay."""
    classes = jaccard.jaccard_classes(docs, SHINGLE_WORDS, PERCENT)
    gone = stored(classes.where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be none. Texts pass once, beside the small plan of the mix."""
    plan = mixing.plan_mix(stored(mixing.sized(docs), "mix-sizes"), WEIGHTS, MOST_COPIES)
    sized = settled(docs.select(*COLUMNS, mixing.size_of(F.col("text")).alias("size")))  # words are split once
    out = mixing.apply_mix(sized, plan)
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return out.where("repeats > 0").select(*COLUMNS, copies.alias("__copy")).drop("__copy")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode(docs)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near duplicates", keep_one),
    ("source mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Estimation, similarity classes and pieces have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
