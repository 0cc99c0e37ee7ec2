"""From documents to packed sequences: quality rules, exact dedup, near duplicates, mixing, packing.

Each stage takes all rows that the one before kept, gives an empty table for an empty one and leaves extra columns alone.  Between stages the rows are a Parquet table in the shared
folder that spark.checkpoint.dir names, so a lost executor costs no stage that is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from affinis.llm.common import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: MinHash joins and tokenizers have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, each row by its own text and host; so do null and empty texts, which have no words."""
    return quality_rules.drop_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, a null id only among its like; of repeated rows one."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, that of the smallest id, a null id being larger than any other."""
    return ngram_join.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole document; up to three times.

    Documents without words are taken never.  Rows are told apart by id and text; of repeated ones each is taken as
    often as the one that the mix takes most.  Rows travel as one struct, so names of columns may clash.
    """
    taken = mixing.mix_sources(docs).rows.filter("size > 0").select(F.col("doc_id").alias("id"), "text_hash", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    times = taken.groupBy("id", "text_hash").agg(F.max("times").alias("times")).filter("times > 0").withColumnsRenamed({"id": "i", "text_hash": "h"})
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(times, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    return joined.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, one row a piece; every row is packed for itself, nulls and repeats as well."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
