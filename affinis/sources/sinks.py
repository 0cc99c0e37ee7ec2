"""Writers: id lists as TSV, the checked submission, samples, logs."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(s1: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """source1_entity_id and the sorted, comma-joined distinct ids of its pairs; empty where it has none.

    s1: s1 and an optional position; pairs: s1, r.  Every S1 record has a row.
    """
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias(column))
    out = s1.join(lists, "s1", "left").withColumn(column, F.coalesce(column, F.lit("")))
    order = [c for c in ("position",) if c in s1.columns] or ["s1"]
    return out.orderBy(*order).select(F.col("s1").alias("source1_entity_id"), column)


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are not among the candidates; must be empty."""
    return matches.select("s1", "r").join(candidates.select("s1", "r"), ["s1", "r"], "left_anti")


def write_tsv(df: DataFrame, path: str) -> None:
    """Fields as they are, in one folder of parts in order; read again by scan_tsv."""
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="", nullValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def publish(folder: str, path: str, df: DataFrame) -> None:
    """Joins a written folder's parts into one file with one header, by the file system that Spark uses."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = fs.create(target, True)
    out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
    for part in sorted(str(s.getPath()) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
    out.close()


def write_submission(folder: str, s1: DataFrame, candidates: DataFrame, matches: DataFrame) -> None:
    """candidate_pairs.tsv and matching_results.tsv, one row for each S1 record; refuses matches that are no candidates."""
    stray = not_candidates(matches, candidates).limit(5).collect()
    if stray:
        raise ValueError(f"matches that are not candidates: {[tuple(r) for r in stray]}")
    # The two files' names and second columns.
    for name, column, pairs in (("candidate_pairs", "candidate_entity_ids", candidates), ("matching_results", "matched_entity_ids", matches)):
        lists = id_lists(s1, pairs, column)
        parts = f"{folder}/_{name}"
        lists.write.mode("overwrite").options(sep="\t", header=False, quote="", escapeQuotes=False, emptyValue="", nullValue="", lineSep="\n").csv(parts)
        publish(parts, f"{folder}/{name}.tsv", lists)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of an experiment log, with the time; one schema for all rows."""
    df.withColumn("logged_at", F.lit(datetime.now(UTC).isoformat(timespec="seconds"))).write.mode("append").parquet(path)


def save_config(config: dict, path: str, df: DataFrame) -> None:
    df.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
