"""Operators over whole tables, against plain Python and DuckDB."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from affinis.llm import exact_dedup, mixing, quality_rules, queries
from affinis.llm.oracles import ORACLE_SQL

SPACE = "[^\x20\x09-\x0d]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check_copies(rows, got):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lowered(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup(spark, nasty, nasty_rows, empty):
    check_copies(nasty_rows, exact_dedup.content_sort(nasty).collect())
    assert exact_dedup.content_sort(empty).count() == 0
    # groups of copies that go over many ranges
    rows = [(i, "same Text" if i % 3 else f"text {i % 7} " * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_copies(rows, exact_dedup.content_sort(df, partitions=40).collect())
    assert exact_dedup.drop_copies(df).count() == len({lowered(t) for _, t in rows})


def rule_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 20 or 100 * rep > 30 * n


def test_quality(nasty, nasty_rows, empty):
    got = quality_rules.quality(nasty).collect()
    assert Counter((r[0], *r[1:7]) for r in got) == Counter((r[0], *rule_counts(r[1])) for r in nasty_rows)
    assert all(r.kept <= (not r.base_failed) and (r.kept or r.base_failed or r.soft_failed) for r in got)
    assert quality_rules.quality(empty).count() == 0


def test_bad_host_loses_only_documents_that_fail_a_rule(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bad = good + " ###" * 6
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(1000 + i, good if i % 10 else bad, f"h{i % 9}") for i in range(900)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept == (t == good) for i, t, _ in rows[:100])
    assert all(got[i].kept for i, *_ in rows[100:])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def highest_quotients(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


def test_sainte_lague():
    import random

    rng = random.Random(1)
    for _ in range(200):
        votes = [rng.choice([0, rng.randrange(1, 1000), rng.random() * 10]) for _ in range(rng.randrange(1, 9))]
        if not any(votes):
            continue
        seats = rng.randrange(0, 60)
        assert mixing.sainte_lague(votes, seats) == highest_quotients(votes, seats)
    quotas = mixing.shard_quotas([50.0, 30.0, 20.0], 1000, 7)
    assert [sum(c) for c in zip(*quotas, strict=True)] == [500, 300, 200] and all(min(q) >= 0 for q in quotas)
    assert {sum(q) for q in quotas} <= {142, 143}


def test_capped_targets():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.capped_targets([1000, 10, 10], [1, 2, 3])
    assert got == pytest.approx([960, 30, 30])


def check_mix(rows, got):
    size = lambda t: len(re.findall(SPACE, t or ""))
    total = Counter()
    for _, t, _, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.capped_targets([total[s] for s in order], [k % 3 + 1 for k in range(len(order))]), strict=True))
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((i, size(t), total[s], round(targets[s], 6)) for i, t, _, s in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(total.values()), rel=0.02)
    return targets


def test_mixing(spark, sf, nasty, nasty_rows, empty):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_mixing(spark, sf).collect()
    targets = check_mix([(r.doc_id, r.text, r.lang, r.source) for r in docs.values()], got)
    taken = Counter()
    for r in got:
        taken[docs[r.doc_id].source] += r.taken
    assert all(taken[s] == pytest.approx(t, rel=0.03) for s, t in targets.items())
    assert sorted(got) == sorted(queries.op8_mixing(spark, sf).collect())
    check_mix(nasty_rows, mixing.mix_sources(nasty).rows.collect())
    assert mixing.mix_sources(empty).rows.count() == 0 and mixing.mix_sources(empty).quotas.count() == 0


def test_shards_get_their_quotas(spark):
    """Blocks go to shards by quota: the words of a source in a shard are its blocks', but where the source ends."""
    rows = [(i, "w " * (i % 37), f"s{i % 5}" if i % 3 else "hot") for i in range(900)] + [(2000, "w " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mix = mixing.mix_sources(docs, block=4, shards=5)
    source = {i: s for i, _, s in rows}
    words = Counter()
    for r in mix.rows.collect():
        parts = dict(map(int, p.split(":")) for p in r.shards.split(",") if p)
        assert sum(parts.values()) == r.taken and all(parts.values())
        for k, n in parts.items():
            words[k, source[r.doc_id]] += n
    quotas = {(r.shard, r.source): 4 * r.blocks for r in mix.quotas.collect()}
    assert all(words[key] <= n for key, n in quotas.items()) and sum(quotas.values()) - sum(words.values()) <= 4 * 7
    for k in range(4):
        assert all(words[k, s] == quotas[k, s] for s in set(source.values()) if quotas[k, s] and words[k + 1, s])
