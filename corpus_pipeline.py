"""The corpus pipeline: raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import quality
from vitrine.llm.decontaminate import decontaminate
from vitrine.llm.line_dedup import LineDedupParams, line_dedup
from vitrine.llm.near_dedup import NearDedupParams, near_dedup
from vitrine.llm.packing import pack
from vitrine.llm.queries import END_ID, PACK_LIMITS, TOKENIZER, packed_rows, table
from vitrine.llm.workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a source's pages above which a line is boilerplate; lines repeated over many sources are at 2 to 5 % of each.
LINE_RATIO = 0.02


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the junk nor the toxicity scorer rejects."""
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return quality.keep_clean(docs, quality.fit(docs.withColumnRenamed("doc_id", "id"), labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    cleaned = line_dedup(docs, LineDedupParams(ratio=LINE_RATIO), carry=("lang", "source"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    dropped = near_dedup(docs, NearDedupParams(percent=80)).filter("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, nor one with a word changed, put in or left out."""
    searched = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    found = searched.filter((F.size("hits") > 0) | (F.size("near") > 0)).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    return packed_rows(pack(docs, public_tokenizers.path(TOKENIZER), END_ID, PACK_LIMITS))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: Models and connected components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each to the stored result of the one before."""
    workspace = Workspace(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = workspace.store(stage(spark, docs, sf_dir), name)
        if before:
            workspace.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
