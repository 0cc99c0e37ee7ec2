"""Command line: train, predict, stack, and the studies of blocking, misses and errors.

    python -m affinis.plans.cli train --data-dir dataset --store tables --model-dir models
    python -m affinis.plans.cli predict --data-dir dataset --store tables --model-dir models --output out

Tables of candidates and features are kept in --store as Parquet, under a name made of the split and the settings
that shape them; --reuse reads them again.
"""

from __future__ import annotations

import argparse
import hashlib
import json
from dataclasses import asdict

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import blocking, decide, evaluate, model, ranking, records, sampling
from affinis.plans import linkage
from affinis.plans.linkage import Config
from affinis.sources import shared, sinks, tables


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="affinis")
    sub = top.add_subparsers(dest="command", required=True)
    # Names of the commands and options, and their defaults.
    for name in ("train", "predict", "stack", "eval-blocking", "eval-reverse", "misses", "errors"):
        p = sub.add_parser(name)
        p.add_argument("--data-dir", default="dataset")
        p.add_argument("--split", default="test" if name == "predict" else "train")
        p.add_argument("--store", default="store")
        p.add_argument("--model-dir", default="models")
        p.add_argument("--output", default="output")
        p.add_argument("--countries", nargs="*", help="only these; all by default")
        p.add_argument("--reuse", action="store_true", help="read stored features")
        p.add_argument("--k", type=int, default=10)
        p.add_argument("--m", type=int, default=3)
        p.add_argument("--rev-m", type=int, default=3)
        p.add_argument("--max-df", type=int, default=5000)
        p.add_argument("--max-df-pair", type=int, default=5000)
        p.add_argument("--n-train", type=int, default=300_000)
        p.add_argument("--n-val", type=int, default=50_000)
        p.add_argument("--rounds", type=int, default=50)
        p.add_argument("--folds", type=int, default=3)
        p.add_argument("--baseline", type=float, default=None, help="refuse a model whose macro F0.5 does not exceed it")
        p.add_argument("--no-name-freq", action="store_true")
        p.add_argument("--sample", type=int, default=0, help="entities or pairs a country; 0: all")
        p.add_argument("--n-show", type=int, default=20)
        p.add_argument("--note", default="")
    return top.parse_args(argv)


def _config(a: argparse.Namespace) -> Config:
    dropped = set(linkage.pairs.FREQUENCY_FEATURES) if a.no_name_freq else set()
    return Config(k=a.k, m=a.m, rev_m=a.rev_m, word_cap=a.max_df, pair_cap=a.max_df_pair, n_train=a.n_train, n_val=a.n_val, rounds=a.rounds, features=[f for f in linkage.FEATURES if f not in dropped])


def _tokens(spark: SparkSession, a: argparse.Namespace, split: str) -> DataFrame:
    rows = tables.scan_sources(spark, a.data_dir, split)
    return records.with_tokens(rows.filter(F.col("country").isin(a.countries)) if a.countries else rows)


def _truth(spark: SparkSession, a: argparse.Namespace, tokens: DataFrame) -> DataFrame:
    """country, s1, r of the S1 records that are there."""
    s1 = tokens.filter("src = 1").select("country", F.col("entity_id").alias("s1"))
    return tables.ground_truth(spark, f"{a.data_dir}/train/train_ground_truth.tsv").join(s1, "s1").select("country", "s1", "r")


def _fingerprint(tokens: DataFrame) -> str:
    """Number of the records and the sum of their hashes, so that stored features of other records are not taken for theirs."""
    hashes = F.sum(F.xxhash64("country", "src", "entity_id", "business_name", "business_address").cast("decimal(38,0)"))
    return "-".join(map(str, tokens.agg(F.count("*"), hashes).first()))


def _features(spark: SparkSession, a: argparse.Namespace, tokens: DataFrame, split: str, config: Config) -> DataFrame:
    shape = {k: v for k, v in asdict(config).items() if k in ("k", "m", "rev_m", "word_cap", "pair_cap")} | {"split": split, "countries": a.countries, "content": _fingerprint(tokens)}
    path = f"{a.store}/features-{split}-{hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()[:16]}"
    if not (a.reuse and shared.exists(spark, path)):
        linkage.features(linkage.candidates(tokens, config), tokens).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _s1(tokens: DataFrame) -> DataFrame:
    return tokens.filter("src = 1").select("country", F.col("entity_id").alias("s1"))


def train(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    config, tokens = _config(a), _tokens(spark, a, a.split)
    found = _features(spark, a, tokens, a.split, config)
    fitted, chosen, metrics = linkage.train(found, _s1(tokens), _truth(spark, a, tokens), config, a.baseline)
    fitted.write().overwrite().save(f"{a.model_dir}/model")
    sinks.save_config(asdict(chosen), f"{a.model_dir}/config", metrics)
    sinks.append_log(metrics.withColumns({"note": F.lit(a.note), "config": F.lit(json.dumps(asdict(chosen)))}), f"{a.model_dir}/log")
    print(*model.importance(fitted, chosen.features)[:12], sep="\n")
    return metrics


def _saved(spark: SparkSession, a: argparse.Namespace) -> tuple[GBTClassificationModel, Config]:
    return GBTClassificationModel.load(f"{a.model_dir}/model"), Config(**sinks.load_config(spark, f"{a.model_dir}/config"))


def predict(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    fitted, config = _saved(spark, a)
    tokens = _tokens(spark, a, a.split)
    found = _features(spark, a, tokens, a.split, config)
    s1 = tables.in_order(spark, f"{a.data_dir}/{a.split}/{a.split}_source1.tsv").withColumnRenamed("entity_id", "s1")
    expect = [r["country"] for r in tables.countries_of(_s1(tokens)).collect()]  # one row a country
    out = linkage.predict(fitted, found, s1.join(_s1(tokens), "s1", "left_semi"), config, a.output, expect)
    return out.groupBy("country").agg(F.count("*").alias("candidates"), F.sum(F.col("accepted").cast("long")).alias("matches"))


def _validation(spark: SparkSession, a: argparse.Namespace, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled pair features with their part, entities of the validation part, tokens."""
    tokens = _tokens(spark, a, a.split)
    truth = _truth(spark, a, tokens)
    split = sampling.entity_split(_s1(tokens), config.n_train, config.n_val).filter("part is not null")
    rows = evaluate.label_pairs(_features(spark, a, tokens, a.split, config), truth).join(split, ["country", "s1"])
    return rows.withColumn("label", F.col("is_true").cast("double")), evaluate.gold_counts(split.filter("part = 'val'"), truth), tokens


def stack(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A second stage on the first one's out-of-fold probabilities and their standing among an S1 record's pairs."""
    config = _config(a)
    rows, entities, _ = _validation(spark, a, config)
    key = F.xxhash64("country", "s1").bitwiseAND(0x7FFFFFFF)
    seen, models = model.out_of_fold(rows.filter("part = 'train'"), config.features, key, folds=a.folds, rounds=a.rounds)
    new = model.mean_prediction(rows.filter("part = 'val'"), models, config.features)
    names = [*config.features, "p1_rank_s1", "p1_max_s1", "p1_gap_s1", "p1_n50_s1", "p1_sum_s1", "p1_ratio_s1", "p1_second_s1", "p1"]
    second = model.fit(model.stacked_features(seen).drop("p"), names, rounds=a.rounds)
    scored = model.predict(second, model.stacked_features(new).drop("p"), names).select("country", "s1", "r", "p", "is_true")
    best = decide.best_threshold(decide.threshold_grid(scored, entities), largest=True)
    if a.baseline is not None and best.first()["macro_f05"] <= a.baseline:
        raise ValueError("the model does not exceed the baseline")
    second.write().overwrite().save(f"{a.model_dir}/stacked")
    return best


def _ranked(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    tokens = _tokens(spark, a, a.split)
    weights = linkage.stored_weights(tokens, a.max_df, a.max_df_pair)
    found = blocking.near_pairs(weights, max(*GRID_K, getattr(a, "k", 0)), 3)  # ranks from there on are asked for by no command
    return blocking.ranked_pairs(found), _truth(spark, a, tokens), _s1(tokens), weights


# Settings that are tried; 0 stands for no limit.
GRID_K, GRID_M = (3, 5, 8, 10, 15, 20), (0, 1, 2, 3)


def eval_blocking(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pair recall, candidates and ceiling over k and m."""
    ranked, truth, s1, _ = _ranked(spark, a)
    s1 = sampling.hash_sample(s1, "s1", a.sample, groups=["country"])
    ranked = ranked.join(s1, ["country", "s1"], "left_semi")
    ranked = linkage.stored(ranked, "ranked")
    every = lambda df, name, values: df.withColumn(name, F.explode(F.array(*[F.lit(v).cast("int") for v in values])))
    pairs = every(evaluate.label_pairs(ranked, truth), "k", GRID_K).filter("fwd_rank < k")
    pairs = every(pairs.withColumn("again", ranking.rank_within(("k", "country", "r"), "score", "s1")), "m", GRID_M).filter("m = 0 or again < m")
    entities = every(every(evaluate.gold_counts(s1, truth), "k", GRID_K), "m", GRID_M)
    out = evaluate.blocking_recall(pairs, entities, ["k", "m"]).withColumn("m", F.nullif("m", F.lit(0)))
    out = linkage.stored(out, "grid")  # one row a setting and country
    sinks.append_log(out.withColumns({"note": F.lit(a.note), "max_df": F.lit(a.max_df), "max_df_pair": F.lit(a.max_df_pair), "sample": F.lit(a.sample)}), f"{a.model_dir}/blocking_log")
    return out.select("k", "m", "country", "pair_recall", "cands_per_s1", "ceiling_f05").orderBy("country", "k", "m")


def eval_reverse(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Recall of true pairs forward, in reverse, and by either."""
    ranked, truth, _, _ = _ranked(spark, a)
    truth = sampling.hash_sample(truth.withColumn("pair", F.concat("s1", "r")), "pair", a.sample, groups=["country"])
    found = truth.join(ranked.select("country", "s1", "r", "src", "fwd_rank", "rev_rank"), ["country", "s1", "r"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    fwd, rev = F.col("fwd_rank") < a.k, F.col("rev_rank")
    return found.groupBy("country").agg(F.count("*").alias("n"), share(fwd).alias("forward"), *[share(rev < m).alias(f"reverse_{m}") for m in (1, 2, 3)], *[share(fwd | (rev < m)).alias(f"either_{m}") for m in (1, 2, 3)])


def misses(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """True pairs that the forward search misses: share no key, or are crowded out by the k-th score."""
    ranked, truth, _, weights = _ranked(spark, a)
    top = ranked.filter(F.col("fwd_rank") < a.k)
    missed = truth.distinct().join(top, ["country", "s1", "r"], "left_anti")
    scored = evaluate.miss_kinds(blocking.pair_score(missed, weights)).withColumn("src", F.substring("r", 2, 1).cast("long"))
    return scored.join(ranking.kth_scores(top, a.k), ["country", "s1", "src"], "left").groupBy("country", "kind").agg(F.count("*").alias("n"), F.percentile("score", 0.5).alias("median_score"), F.percentile("kth_score", 0.5).alias("median_kth"))


def errors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Examples of each kind of wrong decision on the validation part."""
    fitted, config = _saved(spark, a)
    rows, _, tokens = _validation(spark, a, config)
    scored = linkage.scores(fitted, rows.filter("part = 'val'"), config, "src", "is_true")
    wrong = evaluate.error_kinds(linkage.decided(scored, config), config.floor if config.rule == "expected_f" else config.threshold)
    for by in ("country", "src"):
        evaluate.crosstab(wrong, "kind", by).orderBy("kind", by).show(100, False)
    shown = sampling.hash_sample(wrong.withColumn("pair", F.concat("s1", "r")), "pair", a.n_show, groups=["kind"])
    text = tokens.select("entity_id", "business_name", "business_address")
    one = text.select(F.col("entity_id").alias("s1"), F.col("business_name").alias("name_1"), F.col("business_address").alias("address_1"))
    two = text.select(F.col("entity_id").alias("r"), F.col("business_name").alias("name_2"), F.col("business_address").alias("address_2"))
    return shown.join(one, "s1").join(two, "r").select("kind", "p", "s1", "r", "name_1", "name_2", "address_1", "address_2").orderBy("kind", F.desc("p"))


COMMANDS = {"train": train, "predict": predict, "stack": stack, "eval-blocking": eval_blocking, "eval-reverse": eval_reverse, "misses": misses, "errors": errors}


def main(argv: list[str] | None = None) -> DataFrame:
    a = _arguments(argv)
    out = COMMANDS[a.command](SparkSession.builder.appName("affinis").getOrCreate(), a)
    out.show(200, False)
    return out


if __name__ == "__main__":
    main()
