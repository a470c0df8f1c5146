"""A corpus from raw documents to shards: five stages over the columns of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns they were given. The stages that reject judge each row by
itself, whatever its doc_id: null or repeated ones are rows like any other.
Further columns, whatever their names, come through with their rows; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, quality, sharding, simhash
from textloom.llm.common import cut, free_name, small, table

#: Words that a document needs at least, a shingle of them: beyond that, how short is too short is left to the estimate, for short documents can be clean.
MIN_WORDS = 3


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, and that column's name. Written, so that every later read sees the same numbers."""
    row = free_name("_row", docs.columns)
    return cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def _without(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """keyed without the given rows, and without that column: few rows are broadcast, so that texts stay where they are; many are joined."""
    return keyed.join(small(cut(gone.select(row))), row, "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those of fewer than MIN_WORDS words (null, empty and blank ones too), with repeats above the limit, or far outside their group's estimate.

    Null languages and sources are groups like others; repeated rows are judged alike.
    """
    keyed, row = _keyed(docs)
    return _without(keyed, row, quality.quality_rules(keyed, row, min_words=MIN_WORDS).filter(~F.col("kept")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest id, null ids last; of rows with that id, the first.

    Texts without words are alike; repeated rows are copies.
    """
    keyed, row = _keyed(docs)
    ranked = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("rank"), "text")
    found = simhash.near_duplicates(ranked, "rank")
    return _without(keyed, row, found.filter(F.col("rank.row") != F.col("component_id.row")).select(F.col("rank.row").alias(row)))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; repeated rows are judged alike."""
    keyed, row = _keyed(docs)
    return _without(keyed, row, decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), row).filter("contaminated"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as so many rows; those without words are not taken. Null sources are one source.

    Rows that share an id and a size are taken equally often.
    """
    each = mixing.mix(docs, keep=tuple(docs.columns)).filter("copies > 0")
    return each.select("_kept", F.explode(F.sequence(F.lit(1), "copies"))).select("_kept.*")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard, placed by doc_id without moving a row; all null ids share a shard. Columns of these names come out as input_slot and input_shard."""
    return sharding.shard(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]
#: Robust estimates, components and Newton steps are beyond SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
