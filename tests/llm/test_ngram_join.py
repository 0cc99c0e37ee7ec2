"""The n-gram join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from affinis.llm import components, ngram_join, queries


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return tuple(re.findall("[^\x20\x09-\x0d]+", low))


def brute(rows, threshold=0.8):
    """doc_id -> [(class_id, n_links, n_copies)]; rows without words stand alone."""
    big = 1 << 63
    texts = defaultdict(list)
    for i, t in rows:
        texts[words_of(t)].append(big if i is None else i)
    nodes = [w for w in texts if w]
    sets = [{w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} for w in nodes]
    holders = defaultdict(list)
    for x, s in enumerate(sets):
        for g in s:
            holders[g].append(x)
    both = Counter((a, b) for xs in holders.values() if len(xs) > 1 for a in xs for b in xs if a < b)
    links, root = Counter(), list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = defaultdict(lambda: big)
    for x, w in enumerate(nodes):
        least[find(x)] = min(least[find(x)], *texts[w])
    out = Counter((i, i, 0, 1) for i in texts.get((), ()))
    for x, w in enumerate(nodes):
        out.update((i, least[find(x)], links[x], len(texts[w])) for i in texts[w])
    return Counter(tuple(None if v == big else v for v in k[:2]) + k[2:] for k in out.elements())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert Counter(map(tuple, queries.op4_ngram_join(spark, sf).collect())) == brute([(r.doc_id, r.text) for r in docs])


def test_edge_cases(nasty, nasty_rows, empty):
    assert Counter(map(tuple, ngram_join.near_duplicates(nasty).collect())) == brute([r[:2] for r in nasty_rows])
    assert ngram_join.near_duplicates(empty).count() == 0


def test_large_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    rng = random.Random(2)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        chain = base
        for k in range(30 if g < 3 else 3):
            rows.append((len(rows), edited(rng, base, rng.randrange(0, 3))))
            chain = edited(rng, chain, 1).split()  # drifts away, so links form chains
            rows.append((len(rows), " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, ngram_join.near_duplicates(df).collect())) == brute(rows)
    kept = ngram_join.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k[1] for k in brute(rows)})


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        b, r = ngram_join.bands_for(t, 0.999, 400)
        assert 1 - (1 - t**r) ** b >= 0.999 and b * r <= 400
    assert ngram_join.bands_for(1.0, 0.999)[0] == 1


def test_signatures_collide_as_planned():
    """Pairs of sets at the threshold share a band as often as the formula says."""
    rng = np.random.default_rng(1)
    b, r = ngram_join.bands_for(0.8, 0.9)
    f = ngram_join._odd(b * r, 17)
    hits = 0
    for _ in range(400):
        s = rng.integers(0, 2**63, 90, np.uint64)
        x, y = (s[:81], np.concatenate([s[:72], s[81:]]))  # 72 of 90 in common
        m = (np.minimum.reduce(x[:, None] * f, axis=0) == np.minimum.reduce(y[:, None] * f, axis=0)).reshape(b, r)
        hits += m.all(axis=1).any()
    want = 1 - (1 - 0.8**r) ** b
    assert hits / 400 == pytest.approx(want, abs=0.06)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 3000 + i) for i in range(100)]
    root = {}
    for u, v in edges:
        if u != v:
            root.setdefault(u, u), root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and root[u] != root[v]:
                root[u] = root[v] = min(root[u], root[v])
                changed = True
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == root and got.count() == len(root)


def test_few_edges_are_solved_in_one_task_and_many_by_stars(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000)]
    given = spark.createDataFrame(edges, "u long, v long").repartition(5)
    found, jobs = [], []
    for alone in (components.ALONE, -1):
        monkeypatch.setattr(components, "ALONE", alone)
        spark.sparkContext.setJobGroup(f"alone {alone}", "")
        found.append(sorted(map(tuple, components.components(given).collect())))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"alone {alone}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert found[0] == found[1] == sorted(root.items())
    assert jobs[0] <= 6 < jobs[1]
    assert components.components(given.filter("u = v")).count() == 0
