"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, in this order.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the pieces of
the packed sequences. ``run`` writes every stage's result in the shared folder and reads it back, so that a lost executor never sends the work
back further than one stage; a stage's input is deleted once its result is written.

Defined results
* null, empty and wordless texts fail the quality rules and go. Empty tables: an empty result.
* null ids: ids like any other. Equal ids with different texts are different documents; of rows that agree in id and text one stays (near dedup).
* ties: near dedup keeps the least id, line dedup the line of the least id; the mix's order of equal ids is that of their sizes and hashes.
* very long texts: every stage works on the whole text; line dedup, mixing and packing cut it, none drops a part for its length.
* other columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from docspark.llm.common import discard, documents, materialize


def _docs(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir) if docs is None else docs


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept; the others go."""
    return quality_rules.keep_good(_docs(spark, docs, sf_dir))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that stand in an earlier one."""
    return line_dedup.remove_repeated_lines(_docs(spark, docs, sf_dir))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    return near_dedup.keep_one_each(_docs(spark, docs, sf_dir))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and with the words, that the mix takes."""
    return mixing.mixed_documents(_docs(spark, docs, sf_dir))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(_docs(spark, docs, sf_dir), packing.default_ranks())


STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_lines),
    ("near dedup", stage_near),
    ("mixing", stage_mix),
    ("packing", stage_pack),
]
#: The fitted rules and the drawn mix have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
