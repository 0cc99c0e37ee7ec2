"""Profiles of sources and of true pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.sources.shared import stored
from affinis.functions.text import empty_address, postal_code


def profile_source(records: DataFrame) -> DataFrame:
    """src, metric, value: rows, repeated ids and rows, empty fields, distinct values, lengths, postal codes."""
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    q = lambda c, p: F.percentile(F.length(c), p)
    row = F.struct(name.alias("n"), addr.alias("a"), F.coalesce("country", F.lit("")).alias("c"))
    metrics = {
        "rows": F.count("*"),
        "repeated_ids": F.count("*") - F.countDistinct("entity_id"),
        "repeated_rows": F.count("*") - F.countDistinct(row),
        "empty_names": F.sum((F.trim(name) == "").cast("long")),
        "empty_addresses": F.sum(empty_address(F.col("business_address")).cast("long")),
        "distinct_names": F.countDistinct(name),
        "distinct_addresses": F.countDistinct(addr),
        "name_length_q05": q(name, 0.05),
        "name_length_q50": q(name, 0.5),
        "name_length_q95": q(name, 0.95),
        "addr_length_q05": q(addr, 0.05),
        "addr_length_q50": q(addr, 0.5),
        "addr_length_q95": q(addr, 0.95),
        "postal_share": F.avg(postal_code(addr).isNotNull().cast("double")),
    }
    wide = records.groupBy("src").agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
    return wide.unpivot(["src"], list(metrics), "metric", "value")


def country_counts(records: DataFrame, most: int = 10) -> DataFrame:
    """The commonest countries of each source."""
    n = records.groupBy("src", "country").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "country"))
    return n.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


def match_histogram(gold_counts: DataFrame, most: int = 6) -> DataFrame:
    """matches (the last class is open), n, share; a record without a match is a singleton."""
    n = gold_counts.groupBy(F.least("n_gold", F.lit(most)).cast("long").alias("matches")).agg(F.count("*").alias("n"))
    return with_share(n, [], "n")


def multi_owner(gold: DataFrame) -> DataFrame:
    """Records that belong to more than one S1 record."""
    return gold.groupBy("country", "r").agg(F.countDistinct("s1").alias("owners")).filter("owners > 1")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    return with_share(df.groupBy(column).agg(F.count("*").alias("n")), [], "n")


def with_share(counts: DataFrame, groups: Sequence[str], n: str) -> DataFrame:
    """Adds share of a group's total."""
    total = counts.groupBy(*groups).agg(F.sum(n).alias("_total"))
    joined = counts.join(total, list(groups)) if groups else counts.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("share", F.col(n) / F.col("_total")).drop("_total")


def quantiles(df: DataFrame, value: Column, at: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, as q, value."""
    q = F.percentile(value, F.array(*[F.lit(float(a)) for a in at]))
    one = df.groupBy(*groups).agg(q.alias("_v"))
    return one.select(*groups, F.explode(F.arrays_zip(F.array(*[F.lit(float(a)) for a in at]).alias("q"), F.col("_v").alias("value"))).alias("_z")).select(*groups, F.col("_z.q").alias("q"), F.col("_z.value").alias("value"))


def average_rank(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the rank of a value from 1, ties at their mean.

    Ranks come from counts of distinct values in sorted order, so equal values don't meet in one task; the running sum
    is taken within ranges of values, over the ranges' totals.
    """
    n = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    # stored, since the partition's number is read twice
    ranged = stored(n.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum("_c").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inner = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_in", F.coalesce(F.sum("_c").over(inner), F.lit(0))).join(F.broadcast(before), "_part")  # a row a partition
    ranks = placed.select("_v", (F.col("_before") + F.col("_in") + (F.col("_c") + 1) / 2).alias(to))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns, ties at their mean rank; rows with a null are left out."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return average_rank(average_rank(rows, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def group_spread(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Median of max - min over groups of more than one row."""
    each = df.groupBy(*groups).agg((F.max(value) - F.min(value)).alias("spread"), F.count("*").alias("c")).filter("c > 1")
    return each.agg(F.percentile("spread", 0.5).alias("median_spread"), F.count("*").alias("n_groups"))


def overlap_rate(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Share of left rows whose key occurs on the right."""
    a, b = left.select(key.alias("k")), right.select(key.alias("k"))
    both = a.join(b, "k", "left_semi").agg(F.count("*").alias("shared"))
    return a.agg(F.count("*").alias("n")).crossJoin(F.broadcast(both)).select("n", "shared", (F.col("shared") / F.col("n")).alias("rate"))  # one row


def row_key(name: str = "business_name", addr: str = "business_address") -> Column:
    """Lower-case trimmed name and address, for rows that are the same but for their id."""
    return F.concat_ws("|", F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(addr, F.lit("")))))


def simple_tokens(text: Column) -> Column:
    """Distinct lower-case words, underscores kept."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda t: t != ""))


def true_pair_stats(joined: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Means over true pairs with both sides' name_1, name_2, address_1, address_2."""
    from affinis.operators.pairs import jaccard

    n1, n2, a1, a2 = (simple_tokens(F.col(c)) for c in ("name_1", "name_2", "address_1", "address_2"))
    return joined.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg((F.lower("name_1") == F.lower("name_2")).cast("double")).alias("same_name"),
        F.avg((F.lower("address_1") == F.lower("address_2")).cast("double")).alias("same_address"),
        F.avg(jaccard(n1, n2)).alias("name_jaccard"),
        F.avg(jaccard(a1, a2)).alias("addr_jaccard"),
    )


def sample_with_distractors(records: DataFrame, gold: DataFrame, n_s1: int, n_other: int, seed: int = 42) -> DataFrame:
    """A small test set: n_s1 S1 records, all their matches, and n_other records that match nothing."""
    from affinis.operators.sampling import hash_sample

    s1 = hash_sample(records.filter("src = 1"), "entity_id", n_s1, seed)
    kept = gold.join(s1.select(F.col("entity_id").alias("s1"), "country"), ["country", "s1"], "left_semi").select("country", F.col("r").alias("entity_id")).distinct()
    matches = records.filter("src != 1").join(kept, ["country", "entity_id"], "left_semi")
    free = records.filter("src != 1").join(gold.select("country", F.col("r").alias("entity_id")), ["country", "entity_id"], "left_anti")
    return s1.unionByName(matches).unionByName(hash_sample(free, "entity_id", n_other, seed))
