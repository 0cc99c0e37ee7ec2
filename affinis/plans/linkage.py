"""Training and prediction end to end, on record tables with country, src, entity_id and texts.

No loop over countries: country is part of every key.  Candidates and features are stored by the caller, e.g. as
Parquet by content and settings, where they are used more than once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators import blocking, decide, evaluate, model, pairs, ranking, records, sampling
from affinis.sources.shared import stored
from affinis.sources.sinks import write_submission

# Names and order of the context columns, and the settings' defaults below.
CONTEXT_FEATURES = ["src", "score", "fwd_rank", "rev_rank", "s1_best", "n_cands_s1", "r_best", "n_cands_r", "r_second", "s1_gap", "s1_ratio", "r_gap", "r_margin"]
BASE_FEATURES = CONTEXT_FEATURES + pairs.SET_FEATURES + pairs.SIMILARITY_FEATURES
FEATURES = BASE_FEATURES + pairs.NUMBER_FEATURES + pairs.FREQUENCY_FEATURES


@dataclass
class Config:
    """Settings of a run; one schema for training and prediction."""

    k: int = 10
    m: int | None = 3
    rev_m: int = 3
    word_cap: int = 5000
    pair_cap: int = 5000
    n_train: int = 300_000
    n_val: int = 50_000
    rounds: int = 50
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)
    #: How pairs are accepted: "threshold", or "expected_f" with missed and floor.
    rule: str = "threshold"
    missed: float = 0.2
    floor: float = 0.1
    #: Trees of the model that count; 0: all.
    trees: int = 0
    features: list[str] = field(default_factory=lambda: list(FEATURES))


def stored_weights(tokenised: DataFrame, word_cap: int, pair_cap: int) -> DataFrame:
    """Weighted keys, stored: the cut reads the keys twice and the pair join reads the weights from both sides."""
    keys = stored(records.record_keys(tokenised), "keys")
    return stored(blocking.weighted_keys(keys, tokenised, blocking.caps(word_cap, pair_cap)), "weights")


def candidates(tokenised: DataFrame, config: Config) -> DataFrame:
    """country, s1, r, src, score and the context columns."""
    weighted = stored_weights(tokenised, config.word_cap, config.pair_cap)
    found = blocking.candidates(blocking.near_pairs(weighted, config.k, config.rev_m), config.k, config.m, config.rev_m)
    return ranking.context_features(found)


def features(found: DataFrame, tokenised: DataFrame) -> DataFrame:
    """All features of candidate pairs; text columns of the records are dropped again."""
    sided = pairs.with_sides(found, tokenised)
    out = pairs.name_freq_features(sided, pairs.name_frequency(tokenised))
    out = pairs.house_number_features(pairs.set_features(pairs.similarity_features(out)))
    return out.select("country", "s1", "r", *FEATURES)


def train(pair_features: DataFrame, s1: DataFrame, gold: DataFrame, config: Config, baseline: float | None = None) -> tuple[GBTClassificationModel, Config, DataFrame]:
    """Model, settings with its size and rule, and the metrics on validation records.

    The first trees alone are tried as well as all, each with the best threshold and the best expected-F rule; the
    best on the validation records is kept, of equal ones the fewest trees.  Countries get thresholds of their own where
    a threshold is the rule.  pair_features should be stored, since the fit reads it many times.  With a baseline the macro F0.5 must exceed it.
    """
    split = sampling.entity_split(s1.select("country", "s1"), config.n_train, config.n_val).filter("part is not null")
    labelled = evaluate.label_pairs(pair_features, gold).join(split, ["country", "s1"])
    rows = labelled.withColumns({"label": F.col("is_true").cast("double"), "held": F.col("part") == "val"})
    fitted = model.fit(rows, config.features, validation="held", rounds=config.rounds)
    entities = evaluate.gold_counts(split.filter("part = 'val'"), gold)
    held, tried = rows.filter("held"), []
    for trees in tree_counts(fitted):
        scored = scores(fitted, held, replace(config, trees=trees), "is_true")
        best = decide.choose_rule(scored, entities).first()
        tried.append((round(best["macro_f05"], 9), -trees, scored, best))
    _, trees, scored, best = max(tried, key=lambda t: t[:2])
    chosen = replace(config, trees=-trees, rule=best["rule"])
    if chosen.rule == "threshold":
        own = decide.thresholds_by_country(scored, entities).filter("is_own").collect()  # one row a country
        chosen = replace(chosen, threshold=best["threshold"], thresholds={r["country"]: r["threshold"] for r in own})
    else:
        chosen = replace(chosen, missed=best["missed"], floor=best["floor"])
    metrics = evaluate.macro_f05(entities, decided(scored, chosen))
    if baseline is not None and metrics.first()["macro_f05"] <= baseline:
        raise ValueError("the model does not exceed the baseline")
    return fitted, chosen, metrics


def tree_counts(fitted: GBTClassificationModel) -> list[int]:
    """A quarter, a half, three quarters and all of the trees."""
    n = len(fitted.trees)
    return sorted({max(1, n * k // 4) for k in range(1, 5)})


def scores(fitted: GBTClassificationModel, rows: DataFrame, config: Config, *more: str) -> DataFrame:
    """country, s1, r and p by the trees of a run."""
    out = model.predict_prefix(fitted, rows, config.features, config.trees) if config.trees else model.predict(fitted, rows, config.features)
    return out.select("country", "s1", "r", "p", *more)


def decided(scored: DataFrame, config: Config) -> DataFrame:
    """scored with accepted, by the rule of a run."""
    if config.rule == "expected_f":
        return decide.expected_f(scored, config.missed, config.floor)
    spark = scored.sparkSession
    own = spark.createDataFrame(list(config.thresholds.items()), "country string, threshold double")
    return decide.one_owner(decide.above_threshold(scored, config.threshold, own))


def predict(fitted: GBTClassificationModel, pair_features: DataFrame, s1: DataFrame, config: Config, folder: str | None = None, expect: Sequence[str] = ()) -> DataFrame:
    """country, s1, r, p, accepted of all candidate pairs; with a folder, the two submission files as well.

    Countries in expect must have candidates: a country whose features are missing is an error, not left unmatched.
    """
    scored = decided(scores(fitted, pair_features, config), config)
    if expect:
        there = {r["country"] for r in pair_features.select("country").distinct().collect()}
        if missing := set(expect) - there:
            raise ValueError(f"no candidates for {sorted(missing)}")
    if folder:
        write_submission(folder, s1, scored, scored.filter("accepted"))
    return scored
