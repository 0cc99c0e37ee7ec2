"""Readers and writers: what is written comes back as it was."""

import glob

import pytest
from pyspark.sql import functions as F

from affinis.plans import linkage
from affinis.sources import sinks, tables

ODD = [("S1-1", '"Q Co"', 'x""y', "A"), ("S1-2", "back\\slash", "", "B"), ("S1-3", " lead", 'open "quote', "A"), ("S1-4", "NULL", "<NULL>", "C"), ("S1-5", "é, ü", "", "A")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ODD, ", ".join(f"{c} string" for c in tables.RECORD))
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.scan_tsv(spark, str(tmp_path / "t")).collect())) == sorted(ODD)


def test_scan_picks_columns_by_name(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("extra\tcountry\tbusiness_name\tentity_id\tbusiness_address\n1\tX\tname\tS1-1\taddr\n")
    got = tables.scan_tsv(spark, str(tmp_path / "a.tsv"), tables.RECORD).collect()
    assert [tuple(r) for r in got] == [("S1-1", "name", "addr", "X")]


def test_submission(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "s1 string, position int")
    cands = spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-2", "S2-5")], "s1 string, r string")
    sinks.write_submission(str(tmp_path), s1, cands, cands.filter("r = 'S2-1'"))
    assert (tmp_path / "candidate_pairs.tsv").read_text() == "source1_entity_id\tcandidate_entity_ids\nS1-2\tS2-5\nS1-1\tS2-1,S3-9\nS1-3\t\n"
    assert (tmp_path / "matching_results.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-1\nS1-3\t\n"
    with pytest.raises(ValueError, match="not candidates"):
        sinks.write_submission(str(tmp_path), s1, cands, spark.createDataFrame([("S1-1", "S2-77")], "s1 string, r string"))


def test_truth(spark):
    df = spark.createDataFrame([("S1-1", "S2-1,S3-2,"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, tables.explode_truth(df).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]


def test_log_and_config(spark, tmp_path):
    row = spark.createDataFrame([("run", 0.5)], "name string, f double")
    for _ in range(2):
        sinks.append_log(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.save_config({"k": 10, "thresholds": {"é": 0.5}}, str(tmp_path / "config"), row)
    assert sinks.load_config(spark, str(tmp_path / "config")) == {"k": 10, "thresholds": {"é": 0.5}} and glob.glob(str(tmp_path / "config" / "part-*"))


def test_training_and_prediction(spark, tmp_path):
    """Records whose names differ by a typo and whose numbers differ otherwise; the whole plan finds most."""
    import random

    from affinis.operators.records import with_tokens

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, gold = [], []
    for i in range(120):
        name, addr = [word() for _ in range(3)], f"{rng.randrange(1, 999)} {word()} {word()}"
        rows.append(("x", 1, f"S1-{i}", " ".join(name), addr))
        for src in (2, 3):
            if rng.random() < 0.7:
                other = list(name)
                other[rng.randrange(3)] += "q"
                rows.append(("x", src, f"S{src}-{i}", " ".join(other), addr if rng.random() < 0.7 else ""))
                gold.append(("x", f"S1-{i}", f"S{src}-{i}"))
            else:
                rows.append(("x", src, f"S{src}-n{i}", " ".join([*name[:1], word(), word()]), f"{rng.randrange(1, 999)} {word()}"))
    schema = "country string, src long, entity_id string, business_name string, business_address string"
    tokens = with_tokens(spark.createDataFrame(rows, schema)).cache()
    truth = spark.createDataFrame(gold, "country string, s1 string, r string")
    config = linkage.Config(n_train=80, n_val=40, rounds=5)
    found = linkage.features(linkage.candidates(tokens, config), tokens).cache()
    s1 = tokens.filter("src = 1").select("country", F.col("entity_id").alias("s1"))
    import affinis.operators.model as model

    settings = dict(model.SETTINGS)
    model.SETTINGS.update(minInstancesPerNode=2, maxDepth=3, stepSize=0.3)
    try:
        fitted, chosen, metrics = linkage.train(found, s1, truth, config)
        assert metrics.first().macro_f05 > 0.8
        out = linkage.predict(fitted, found, s1.select("s1"), chosen, str(tmp_path), expect=["x"])
        assert out.filter("accepted").groupBy("r").count().filter("count > 1").count() == 0
        assert len((tmp_path / "matching_results.tsv").read_text().splitlines()) == 121
        prefix = model.predict_prefix(fitted, found, chosen.features, 5)
        both = prefix.select("s1", "r", F.col("p").alias("q")).join(model.predict(fitted, found, chosen.features), ["s1", "r"])
        assert both.filter(F.abs(F.col("p") - F.col("q")) > 1e-6).count() == 0
        with pytest.raises(ValueError, match="baseline"):
            linkage.train(found, s1, truth, config, baseline=1.0)
        with pytest.raises(ValueError, match="no candidates"):
            linkage.predict(fitted, found, s1.select("s1"), chosen, expect=["x", "y"])
    finally:
        model.SETTINGS.update(settings)
