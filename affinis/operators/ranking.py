"""Ranks, gaps and totals within groups of pairs, as window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(groups: Sequence[str], score: str, tie: str) -> Column:
    """Place by falling score from 0; ties by rising tie column."""
    return F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(tie))) - 1


def context_features(pairs: DataFrame) -> DataFrame:
    """How a pair stands among the pairs of its S1 record and of its other record.

    pairs: country, s1, r, src, score.
    """
    s1, r = Window.partitionBy("country", "s1"), Window.partitionBy("country", "r")
    ranked = pairs.withColumns({"fwd_rank": rank_within(("country", "s1", "src"), "score", "r"), "rev_rank": rank_within(("country", "r"), "score", "s1")})
    score = F.col("score")
    totals = ranked.withColumns(
        {
            "s1_best": F.max("score").over(s1),
            "n_cands_s1": F.count("*").over(s1),
            "r_best": F.max("score").over(r),
            "n_cands_r": F.count("*").over(r),
            "r_second": F.coalesce(F.max(F.when(F.col("rev_rank") == 1, score)).over(r), F.lit(0.0)),
        }
    )
    return totals.withColumns(
        {
            "s1_gap": F.col("s1_best") - score,
            "s1_ratio": score / F.greatest("s1_best", F.lit(1e-6)),
            "r_gap": F.col("r_best") - score,
            "r_margin": F.col("r_best") - F.col("r_second"),
        }
    )


def group_features(scored: DataFrame, group: Sequence[str], p: str, tie: str) -> DataFrame:
    """A probability's rank, gaps, totals and rival within its group."""
    w, value = Window.partitionBy(*group), F.col(p)
    ranked = scored.withColumn("p1_rank_s1", rank_within(group, p, tie) + 1)
    most = F.max(p).over(w)
    return ranked.withColumns(
        {
            "p1": value,
            "p1_max_s1": most,
            "p1_gap_s1": most - value,
            "p1_n50_s1": F.sum((value >= 0.5).cast("long")).over(w),
            "p1_sum_s1": F.sum(p).over(w),
            "p1_ratio_s1": value / F.greatest(most, F.lit(1e-6)),
            "p1_second_s1": F.coalesce(F.max(F.when(F.col("p1_rank_s1") == 2, value)).over(w), F.lit(0.0)),
        }
    )


def kth_scores(pairs: DataFrame, k: int) -> DataFrame:
    """Score at place k for each S1 record and source, 0 where there are fewer pairs; pairs hold the best k at most."""
    out = F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(0.0))
    return pairs.groupBy("country", "s1", "src").agg(out.alias("kth_score"))
