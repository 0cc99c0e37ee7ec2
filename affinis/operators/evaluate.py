"""Macro F0.5 over entities, recall of blocking, ceilings, and the error classes of a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(hits: Column, predicted: Column, gold: Column) -> Column:
    """F0.5 of one entity: 1 if nothing is predicted and nothing is true, 0 without a hit."""
    p, r = hits / predicted, hits / gold
    return F.when((gold == 0) & (predicted == 0), 1.0).when(hits == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_counts(entities: DataFrame, pairs: DataFrame, by: Sequence[str] = ("country", "s1")) -> DataFrame:
    """entities (by, n_gold) with p accepted pairs and h true ones; pairs have by, is_true, accepted."""
    got = pairs.filter("accepted").groupBy(*by).agg(F.count("*").alias("p"), F.sum(F.col("is_true").cast("long")).alias("h"))
    return entities.join(got, list(by), "left").fillna(0, ["p", "h"])


def macro_f05(entities: DataFrame, pairs: DataFrame, by: Sequence[str] = ("country", "s1"), groups: Sequence[str] = ()) -> DataFrame:
    """Mean F0.5 over entities (gold counts include matches that blocking missed), pooled precision and recall."""
    counts = entity_counts(entities, pairs, by)
    return pooled(counts, groups)


def pooled(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    h, p, g = (F.sum(c) for c in ("h", "p", "n_gold"))
    return counts.groupBy(*groups).agg(
        F.avg(f05(F.col("h"), F.col("p"), F.col("n_gold"))).alias("macro_f05"),
        (h / F.greatest(p, F.lit(1))).alias("precision"),
        (h / F.greatest(g, F.lit(1))).alias("recall"),
    )


def gold_counts(s1: DataFrame, gold: DataFrame) -> DataFrame:
    """True matches of each S1 record, 0 included.  s1: country, s1; gold: country, s1, r."""
    n = gold.groupBy("country", "s1").agg(F.count("r").alias("n_gold"))
    return s1.select("country", "s1").join(n, ["country", "s1"], "left").fillna(0, ["n_gold"])


def label_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """pairs with is_true."""
    true = gold.select("country", "s1", "r").distinct().withColumn("_true", F.lit(True))
    return pairs.join(true, ["country", "s1", "r"], "left").withColumn("is_true", F.coalesce("_true", F.lit(False))).drop("_true")


def blocking_recall(labelled: DataFrame, entities: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """By country (and extra columns of both tables): share of true pairs that are candidates, candidates per S1 record, and the ceiling of F0.5.

    The ceiling is that of a matcher that accepts the true candidates and nothing else.
    """
    got = labelled.groupBy(*extra, "country", "s1").agg(F.count("*").alias("n_cands"), F.sum(F.col("is_true").cast("long")).alias("h"))
    all_ = entities.join(got, [*extra, "country", "s1"], "left").fillna(0, ["n_cands", "h"])
    recall = F.sum("h") / F.greatest(F.sum("n_gold"), F.lit(1))
    return all_.groupBy(*extra, "country").agg(recall.alias("pair_recall"), (F.sum("n_cands") / F.count("*")).alias("cands_per_s1"), F.avg(ceiling(F.col("h"), F.col("n_gold"))).alias("ceiling_f05"))


def ceiling(hits: Column, gold: Column) -> Column:
    r = hits / gold
    return F.when(gold == 0, 1.0).when(hits == 0, 0.0).otherwise(1.25 * r / (0.25 + r))


def error_kinds(pairs: DataFrame, threshold: float) -> DataFrame:
    """kind of each wrong decision: a true pair below the threshold, one that lost its owner, or a wrong accept."""
    lost = F.col("is_true") & ~F.col("accepted")
    kind = F.when(lost & (F.col("p") < threshold), "FN-low").when(lost, "FN-owner").when(F.col("accepted") & ~F.col("is_true"), "FP")
    return pairs.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def miss_kinds(missed: DataFrame) -> DataFrame:
    """zero: the pair shares no key; crowd: others scored higher."""
    return missed.withColumn("kind", F.when(F.col("score") <= 0, "zero").otherwise("crowd"))


def crosstab(rows: DataFrame, of: str, by: str) -> DataFrame:
    """of, by, share: how each value of `of` spreads over `by`, adding up to 1."""
    n = rows.groupBy(of, by).agg(F.count("*").alias("n"))
    total = n.groupBy(of).agg(F.sum("n").alias("total"))
    return n.join(total, of).select(of, by, (F.col("n") / F.col("total")).alias("share"))
