"""From raw documents to packed sequences, one stored table per stage.

Toxic documents go, then exact copies, then all but one of each group of near-duplicates, then
documents that hold a benchmark item; the rest is packed. No SQL expresses the learned score, the
fingerprints or the packing, so ``ORACLE_SQL`` is None and the tests use brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm.decontaminate import without_benchmark
from ledgermill.llm.exact_dedup import new_index, without_copies
from ledgermill.llm.packing import pack
from ledgermill.llm.simhash import without_near_duplicates
from ledgermill.llm.toxicity import fit, without_toxic
from ledgermill.session import RunStorage, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Tables that the running stage stores. A stage's result is written before the next one starts, so the
# next one begins by removing them.
_STORED: list[RunStorage] = []


def _stage(name: str, build: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _STORED:
            _STORED.pop().remove()
        _STORED.append(RunStorage(spark, name))
        with _STORED[-1]:
            return build(spark, docs, sf_dir)

    return run_stage


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs, new_index(spark, f"pipeline-index-{uuid.uuid4().hex}"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _stage("toxicity", _toxicity)),
    ("exact_dedup", _stage("exact_dedup", _exact_dedup)),
    ("near_dedup", _stage("near_dedup", _near_dedup)),
    ("decontamination", _stage("decontamination", _decontamination)),
    ("packing", _stage("packing", _packing)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
