"""Readers: tab-separated record tables, match lists, and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a record table and of a match list.
RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
SOURCES = (1, 2, 3)


def scan_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A TSV with a header: every field a string as written, quotes literal, empty fields empty strings.

    columns picks fields by their name in the header; all by default.
    """
    raw = spark.read.options(sep="\t", header=True, quote="", escape="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    named = raw.select(*[F.col(f"`{c}`") for c in columns]) if columns else raw
    return named.na.fill("")


def in_order(spark: SparkSession, path: str, column: str = "entity_id") -> DataFrame:
    """A column of a TSV, with position, which orders its rows as in the file, however the scan deals its parts."""
    raw = spark.read.options(sep="\t", header=True, quote="", escape="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.select(F.coalesce(column, F.lit("")).alias(column), place.alias("position"))


def scan_sources(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The three sources of a split as one table with src; columns beyond RECORD are dropped."""
    parts = [scan_tsv(spark, f"{folder}/{split}/{split}_source{k}.tsv", RECORD).withColumn("src", F.lit(k)) for k in SOURCES]
    return concat_sources(*parts)


def concat_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explode_truth(truth: DataFrame) -> DataFrame:
    """s1, r of a match list; empty ids go, ids are not trimmed."""
    each = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return truth.select(F.col("source1_entity_id").alias("s1"), each.alias("r")).filter("r != ''")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1, r of a match list's file, e.g. train/train_ground_truth.tsv."""
    return explode_truth(scan_tsv(spark, path, TRUTH))


def countries_of(*frames: DataFrame) -> DataFrame:
    """The distinct countries of several tables in order; nothing is hard-coded."""
    return concat_sources(*[f.select("country") for f in frames]).distinct().orderBy("country")


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RECORD])
