"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes what its predecessor kept, as a table of the columns of ``documents``; the last returns the packed
pieces. A doc_id stands for one document: stages that drop documents drop all rows of an id.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import storage
from sluice.llm.decontaminate import decontaminate
from sluice.llm.jaccard import jaccard_components
from sluice.llm.packing import pack
from sluice.llm.queries import tokenizer_path
from sluice.llm.substring import dedup_substrings
from sluice.llm.toxicity import score_toxicity

#: Near duplicates share five-word shingles at a Jaccard similarity of 0.8.
SHINGLE, NUM, DEN = 5, 8, 10


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without those of ``ids`` (id). Rows without a doc_id stay."""
    gone = storage.persist(ids.distinct(), name)
    return docs.join(storage.small(gone), docs["doc_id"] == gone["id"], "left_anti")


def _new_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``docs`` has not."""
    return tuple(next(x for i in range(len(docs.columns) + 1) if (x := n + "_" * i).lower() not in {c.lower() for c in docs.columns}) for n in names)


def _lean(stage):
    """``stage`` begins without what stages before it left in the executors, and writes its tables by way of small batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.collect_garbage(spark)
        with storage.narrow_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


@_lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5 stay, null and empty texts with them. Rows that repeat an id are scored one by
    one. All columns stay, whatever their names; an empty table gives an empty one."""
    names = _new_names(docs, "score", "predicted")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), names=names)
    return scored.where(F.col(names[1]) == 0).drop(*names)


@_lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the smallest doc_id stays, with all its rows. Texts without words are in no group;
    rows without a doc_id stay. An empty table gives an empty one."""
    found = jaccard_components(docs, SHINGLE, NUM, DEN)
    return _without(docs, found.where("component_id <> doc_id").select(F.col("doc_id").alias("id")), "copies")


@_lean
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the passages that an earlier one has; n_chars is counted anew (null for null texts).
    Ties, repeated rows and null ids as in ``dedup_substrings``; an empty table gives an empty one."""
    columns = docs.columns
    out = dedup_substrings(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in columns])


@_lean
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with all rows of their id. Null and empty texts, and rows without
    a doc_id, stay; an empty table gives an empty one."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("id")), "leaks")


@_lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, as ``pack`` gives them: a null or empty text is a piece of one token."""
    return pack(docs, tokenizer_path(), end=2, size=1024)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packing),
]

#: SQL can't express learning and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = storage.persist(docs, name)
            if i:
                storage.drop(before)
            storage.release(spark)
    return docs
