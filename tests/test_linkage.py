"""Keys, candidates, pair features, decisions and metrics on small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import blocking, decide, evaluate, pairs, ranking, records, sampling
from affinis.plans import fixtures, more_queries


def record(i, src, name, addr="", country="x"):
    return (country, src, i, name, addr)


def tokenised(spark, *rows):
    return records.with_tokens(spark.createDataFrame(rows, "country string, src long, entity_id string, business_name string, business_address string"))


def keys(spark, src, name, addr=""):
    out = {}
    for r in records.record_keys(tokenised(spark, record("e", src, name, addr))).collect():
        out.setdefault(r.kind, set()).add(r.key)
    return out


def test_keys(spark):
    query, other = keys(spark, 1, "Pk Media Big Co", "12 Main, Pune"), keys(spark, 2, "Pk Media Big Co", "12 Main, Pune")
    words = {"pk", "media", "big", "co"}
    assert query["nu"] == words | {"pkmediabigco", "pkmediabig", "pkmedia"} and other["nu"] == words | {"pkmediabigco", "pkmediabig"}
    assert query["np"] == other["np"] == {"media|pk", "big|pk", "co|pk", "big|media", "co|media", "big|co"}
    assert other["ab"] == {"12_main"} and other["au"] == {"12", "main", "pune"}
    assert "sk" not in other and {"pk", "mt", "k", "k|mt", "#pkmtk"} <= query["sk"]
    assert "sk" in keys(spark, 2, "सुपर")
    assert keys(spark, 1, None, None) == {}


ROWS = [
    record("S1-1", 1, "alpha beta", "1 road"),
    record("S1-2", 1, "gamma delta", "2 road"),
    record("S2-1", 2, "alpha beta", "1 road"),
    record("S2-2", 2, "gamma", "2 lane"),
    record("S3-1", 3, "beta alpha", ""),
    record("S3-2", 3, "omega", "", "y"),
]


def test_candidates(spark):
    t = tokenised(spark, *ROWS)
    w = blocking.weighted_keys(records.record_keys(t), t, blocking.caps(100, 100)).cache()
    norms = w.groupBy("entity_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    found = blocking.scored_pairs(w)
    got = {(r.s1, r.r): r.score for r in found.collect()}
    assert got["S1-1", "S2-1"] == max(got.values()) and ("S1-2", "S2-2") in got and not any(r == "S3-2" for _, r in got)
    top = blocking.top_k(found, 1).groupBy("s1", "src").count().collect()
    assert all(r["count"] == 1 for r in top)
    some = blocking.candidates(found, 1, 1, 1).select("s1", "r").collect()
    assert {tuple(r) for r in some} <= set(got) and len(some) == len(set(some))
    asked = spark.createDataFrame([("x", "S1-1", "S2-1"), ("x", "S1-1", "S3-2")], "country string, s1 string, r string")
    assert {r.r: r.score for r in blocking.pair_score(asked, w).collect()} == {"S2-1": got["S1-1", "S2-1"], "S3-2": 0.0}


def test_near_pairs(spark, sf, monkeypatch):
    """Blocks of few records give the same candidates as the table of all pairs, and only the best pairs leave them."""
    t = fixtures.er_tokens(spark, sf)
    w = blocking.weighted_keys(records.record_keys(t), t, blocking.caps(5000, 5000)).cache()
    pairs_of_all = blocking.scored_pairs(w).cache()
    for name, value in (("LEAST_BLOCK", 7), ("OTHERS", 20), ("PRODUCTS", 50), ("SUMS", 100)):
        monkeypatch.setattr(blocking, name, value)
    for k, rev_m in ((10, 3), (2, 0), (1, 1)):
        near = blocking.near_pairs(w, k, rev_m).cache()
        cut = [blocking.candidates(x, k, 2, rev_m) for x in (near, pairs_of_all)] + [blocking.bidirectional(x, k, rev_m).select("country", "s1", "r", "src", "score", "is_fwd") for x in (near, pairs_of_all)]
        for got, want in (cut[:2], cut[2:]):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert near.exceptAll(pairs_of_all).count() == 0
        assert near.groupBy("s1", "r").count().filter("count > 1").count() == 0
    assert near.count() < pairs_of_all.count()


def test_owned_pairs(spark, sf):
    """Grids get one row a record, the best of all its pairs, and gold counts without the pairs of equal texts."""
    gold = fixtures.er_gold(spark, sf)
    labelled = evaluate.label_pairs(fixtures.er_pairs(spark, sf), gold)
    plain = lambda df, *cols: sorted(map(tuple, df.select("country", *cols).collect()))
    best = fixtures.er_best(spark, sf)
    assert plain(best, "s1", "r", "src", "p", "is_true") == plain(decide.owners(labelled), "s1", "r", "src", "p", "is_true")
    assert best.count() == labelled.select("country", "r").distinct().count() < labelled.count()
    entities = evaluate.gold_counts(fixtures.er_entities(spark, sf), gold)
    assert plain(fixtures.er_gold_counts(spark, sf), "s1", "n_gold") == plain(entities, "s1", "n_gold")
    judged = decide.one_owner(labelled.withColumn("above", F.col("p") >= 0.4))
    want = evaluate.macro_f05(entities, judged).first()
    for scored_pairs in (labelled, best):
        got = decide.threshold_grid(scored_pairs, entities, (0.1, 0.4)).filter("threshold = 0.4").first()
        assert [got[c] for c in ("macro_f05", "precision", "recall")] == pytest.approx([want[c] for c in ("macro_f05", "precision", "recall")])
    want = evaluate.macro_f05(entities, decide.expected_f(labelled, 0.2, 0.1)).first()
    got = decide.rule_grid(best, entities, (0.2, 0.5), (0.1,)).filter("missed = 0.2").first()
    assert [got[c] for c in ("macro_f05", "precision", "recall")] == pytest.approx([want[c] for c in ("macro_f05", "precision", "recall")])


def test_names_of_many_pairs(spark, sf, monkeypatch):
    """A name with many pairs is dealt over tasks; the pairs and the frequencies of their names stay the same."""
    want = fixtures.er_pairs(spark, sf).select("s1", "r", "p").collect()
    t = fixtures.er_tokens(spark, sf)
    joined = pairs.name_freq_features(pairs.with_sides(fixtures.er_pairs(spark, sf).select("country", "s1", "r"), t), pairs.name_frequency(t))
    plain = sorted(map(tuple, joined.select("s1", "r", *pairs.FREQUENCY_FEATURES).collect()))
    monkeypatch.setattr(fixtures, "PAIRS_OF_TASK", 1)
    assert sorted(map(tuple, fixtures.er_pairs(spark, sf).select("s1", "r", "p").collect())) == sorted(map(tuple, want))
    assert sorted(map(tuple, more_queries.name_freq_features(spark, sf).collect())) == plain


def test_string_features_without_moving_pairs(spark, sf):
    """The registered query gives what the operators give on joined pairs, and no exchange lies above the join of names."""
    t = fixtures.er_tokens(spark, sf)
    sided = pairs.with_sides(fixtures.er_pairs(spark, sf).select("country", "s1", "r"), t)
    cols = ["s1", "r", *pairs.SET_FEATURES, *[F.round(c, 6).alias(c) for c in pairs.SIMILARITY_FEATURES]]
    want = pairs.similarity_features(pairs.set_features(sided)).select(*cols)
    got = more_queries.pair_string_features(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_blocks_against_blocks(spark, sf, monkeypatch):
    """Small blocks and pools give each pair once, with the features of the operators on joined pairs."""
    t = fixtures.er_tokens(spark, sf)
    cols = ["s1", "r", *pairs.SET_FEATURES, *[F.round(c, 6).alias(c) for c in pairs.SIMILARITY_FEATURES]]
    texts = [("a", 1, "x", "Acme 7 Ltd", "12 High St 12, Leeds"), ("a", 2, "y", "ACME 7 ltd", ""), ("a", 3, "z", "acme 7 LTD", "120 high st leeds"), ("a", 1, "w", "acme 7 ltd", None), ("a", 2, "v", "Acme 7 ltd", "12 High St 12, Leeds"), ("b", 1, "u", "", "5"), ("b", 2, "t", "", "5"), ("b", 2, "t", "", "é 55")]
    odd = records.with_tokens(spark.createDataFrame(texts, "country string, src long, entity_id string, business_name string, business_address string"))
    monkeypatch.setattr(pairs, "LEFT", 2)
    monkeypatch.setattr(pairs, "RIGHT", 3)
    monkeypatch.setattr(pairs, "SENT", 5)
    for rows in (t, odd):
        one = rows.select("*", F.lower("business_name").alias("low"))
        key = lambda src, name: one.filter(src).select("country", "low", F.col("entity_id").alias(name), F.col("addr_tokens").alias(f"addr{name}"))
        joined = key("src = 1", "s1").join(key("src != 1", "r"), ["country", "low"])
        own = pairs.sides(rows, F.lower("business_name").alias("low"))
        side = lambda src, k: own.filter(src).select("country", "low", F.col("entity_id").alias("s1" if k == 1 else "r"), *[F.col(c).alias(f"{c}{k}") for c in ("name", "addr", "skel", "nums")])
        want = pairs.similarity_features(pairs.set_features(side("src = 1", 1).join(side("src != 1", 2), ["country", "low"]))).select(*cols).collect()
        got = pairs.block_features(pairs.blocked(own, "country", "low")).collect()
        assert len(got) == joined.count() > 5 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rounding_as_spark(spark):
    x = [0.0, 100.0, 0.1234565, 2.6755555, 81.4814815, 0.8333335, 12.3456785, 200 / 3, 200 / 7, 1.0000005, 0.00000050001, 99.9999995]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert pairs._rounded(np.array(x)).tolist() == want


def numbers(spark, a, b):
    df = spark.createDataFrame([(a, b)], "nums1 array<string>, nums2 array<string>")
    return pairs.house_number_features(df).first()


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [("1717", "171", "n_affix"), ("169", "69", "n_affix"), ("202", "203", "n_near1"), ("3004", "3013", "n_other"), ("5", "56", "n_other"), ("7", "7", "n_exact"), ("123456789012", "123456789013", "n_other")],
)
def test_house_numbers(spark, a, b, kind):
    got = numbers(spark, [a], [b])
    assert {k: got[k] for k in ("n_exact", "n_affix", "n_near1", "n_other")} == {k: float(k == kind) for k in ("n_exact", "n_affix", "n_near1", "n_other")}


def test_house_numbers_beyond_one(spark):
    got = numbers(spark, ["3004"], ["3013", "3004"])
    assert got.log_min_diff_other == pytest.approx(2.302585) and got.frac_other == 0.5 and got.first_rel == 3
    none = numbers(spark, [], ["5"])
    assert none.first_rel == -1 and none.log_first_absdiff == -1 and none.log_min_diff_other == -1 and none.n_other == 1


def f_score(spark, g, p, h):
    df = spark.createDataFrame([(g, p, h)], "g long, p long, h long")
    return df.select(evaluate.f05(F.col("h"), F.col("p"), F.col("g")).alias("f")).first().f


def test_f05(spark):
    assert [f_score(spark, *x) for x in ((0, 0, 0), (0, 2, 0), (3, 0, 0), (3, 2, 0))] == [1, 0, 0, 0]
    assert f_score(spark, 4, 2, 2) == pytest.approx(0.8333, abs=1e-4)


def scored(spark, *rows):
    return spark.createDataFrame([("x", *r) for r in rows], "country string, s1 string, r string, p double")


def test_one_owner(spark):
    df = decide.above_threshold(scored(spark, ("a", "r", 0.8), ("b", "r", 0.9), ("a", "q", 0.6)), 0.7)
    assert {(r.s1, r.r) for r in decide.one_owner(df).filter("accepted").collect()} == {("b", "r")}


def test_expected_f(spark):
    assert decide.expected_f(scored(spark, ("a", "r", 0.1))).filter("accepted").count() == 0
    got = decide.expected_f(scored(spark, ("a", "r", 0.9), ("a", "q", 0.85), ("a", "z", 0.05), ("b", "r", 0.8))).filter("accepted").collect()
    assert {(r.s1, r.r) for r in got} == {("a", "r"), ("a", "q")}


def test_context(spark):
    df = spark.createDataFrame([("x", "a", "r", 2, 0.9), ("x", "a", "q", 2, 0.5), ("x", "b", "r", 2, 0.4)], "country string, s1 string, r string, src long, score double")
    got = {(r.s1, r.r): r for r in ranking.context_features(df).collect()}
    assert got["a", "r"].r_second == 0.4 and got["a", "q"].r_second == 0 and got["b", "r"].rev_rank == 1 and got["a", "q"].fwd_rank == 1
    assert got["b", "r"].r_gap == pytest.approx(0.5) and got["a", "r"].r_margin == pytest.approx(0.5) and got["a", "q"].s1_ratio == pytest.approx(5 / 9)


def test_split_is_whole_and_repeats(spark):
    s1 = spark.range(100).select(F.lit("x").alias("country"), F.concat(F.lit("S1-"), "id").alias("s1"))
    a, b = (sorted(map(tuple, sampling.entity_split(s1.repartition(n), 30, 50).select("s1", "part").collect())) for n in (2, 5))
    parts = [p for _, p in a]
    assert a == b and parts.count("val") == 20 and parts.count("train") == 30
