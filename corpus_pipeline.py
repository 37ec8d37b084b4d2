"""From raw documents to packed training sequences: five stages, each an operator of ``ferrule.llm``.

Every stage but the last returns the columns of ``docs`` and works on all rows of its predecessor. Null text: goes in the first stage, as nothing in
it is in a language; a stage called alone keeps it (line dedup, decontamination), or takes it as empty (SimHash: one node with all empty texts; packing: one piece).
Empty text: likewise. Very long texts are processed whole in each stage. Ties and repeated rows: of rows that are equal, or of one component, SimHash keeps the
smallest doc_id; rows with one doc_id and text are one document to line dedup. Null doc_ids are kept and come first in order. Empty table: no rows. Extra
columns are kept up to packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import decontaminate, language_id, line_dedup, packing, simhash
from ferrule.llm.shared import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text no learned language explains."""
    return language_id.accept(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Code lengths, fingerprints and tokens are beyond SQL: tests/llm/test_brute_force.py holds run() against five sequential stages of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
