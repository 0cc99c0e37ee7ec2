"""The command line over a small made-up data set."""

import random

import pytest

from affinis.operators import model
from affinis.plans import cli

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    rng, folder = random.Random(9), tmp_path_factory.mktemp("data")
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for split in ("train", "test"):
        (folder / split).mkdir()
        files, truth = {1: HEADER, 2: HEADER, 3: HEADER}, "source1_entity_id\tmatched_entity_ids\n"
        for i in range(80):
            i = i * 37 % 80  # ids are not in their order
            country, name, addr, hits = rng.choice("AB"), [word() for _ in range(2)] + [word() + "é" * (i % 3 == 0)], f"{rng.randrange(1, 999)} {word()}", []
            files[1] += f"S1-{i}\t{' '.join(name)}\t{addr}\t{country}\n"
            for src in (2, 3):
                if rng.random() < 0.7:
                    files[src] += f"S{src}-{i}\t{' '.join([*name[:2], name[2] + 'x'])}\t{addr}\t{country}\n"
                    hits.append(f"S{src}-{i}")
                else:
                    files[src] += f"S{src}-{i}\t{name[0]} {word()}\t{word()}\t{country}\n"
            truth += f"S1-{i}\t{','.join(hits)}\n"
        for k, text in files.items():
            (folder / split / f"{split}_source{k}.tsv").write_text(text)
        (folder / split / f"{split}_ground_truth.tsv").write_text(truth)
    return folder


def test_commands(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "SETTINGS", model.SETTINGS | {"minInstancesPerNode": 2, "maxDepth": 3, "stepSize": 0.3})
    common = ["--data-dir", str(data), "--store", str(tmp_path / "store"), "--model-dir", str(tmp_path / "m"), "--output", str(tmp_path / "out"), "--n-train", "60", "--n-val", "20", "--rounds", "3"]
    assert cli.main(["train", *common, "--note", "first"]).first().macro_f05 > 0.7
    assert cli.main(["predict", *common]).count() == 2
    lines = [x.split("\t")[0] for x in (tmp_path / "out" / "matching_results.tsv").read_text().splitlines()]
    assert lines[1:] == [x.split("\t")[0] for x in (data / "test" / "test_source1.tsv").read_text().splitlines()[1:]]  # in the order of the input
    saved = cli.sinks.load_config(spark, f"{tmp_path}/m/config")
    assert saved["rule"] in ("threshold", "expected_f") and 1 <= saved["trees"] <= 3
    recall = cli.main(["eval-reverse", *common]).collect()
    assert all(r.either_3 >= max(r.forward, r.reverse_3) for r in recall)
    grid = cli.main(["eval-blocking", *common]).collect()
    assert len(grid) == 2 * 6 * 4 and all(0 <= r.pair_recall <= 1 for r in grid)
    assert spark.read.parquet(f"{tmp_path}/m/blocking_log").count() == len(grid)
    cli.main(["misses", *common, "--k", "1"])
    cli.main(["errors", *common, "--reuse"])
    assert cli.main(["stack", *common, "--reuse"]).first().macro_f05 > 0.7


def test_a_rule_that_was_chosen_is_used(spark):
    from affinis.operators import decide
    from affinis.plans import linkage

    scored = spark.createDataFrame([("A", "1", "x", 0.6), ("A", "1", "y", 0.3), ("A", "2", "z", 0.2)], "country string, s1 string, r string, p double")
    for config, want in ((linkage.Config(threshold=0.25), decide.one_owner(decide.above_threshold(scored, 0.25))), (linkage.Config(rule="expected_f", missed=0.0, floor=0.05), decide.expected_f(scored, 0.0, 0.05))):
        accepted = lambda df: sorted(r.r for r in df.filter("accepted").collect())
        assert accepted(linkage.decided(scored, config)) == accepted(want)
    assert cli.GRID_K and linkage.Config().rule == "threshold"


def test_a_country_without_candidates_is_refused(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "SETTINGS", model.SETTINGS | {"minInstancesPerNode": 2, "maxDepth": 2, "stepSize": 0.3})
    common = ["--data-dir", str(data), "--store", str(tmp_path / "store"), "--model-dir", str(tmp_path / "m"), "--output", str(tmp_path / "out"), "--n-train", "60", "--n-val", "20", "--rounds", "1"]
    cli.main(["train", *common])
    one = data / "test" / "test_source1.tsv"
    before = one.read_text()
    one.write_text(before + "S1-900\tlonely name\t1 road\tC\n")
    try:
        with pytest.raises(ValueError, match="no candidates"):
            cli.main(["predict", *common, "--reuse"])  # stored features of other records are not used either
    finally:
        one.write_text(before)
