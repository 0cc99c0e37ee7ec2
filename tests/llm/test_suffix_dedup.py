"""Substring dedup against a plain scan of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from affinis.llm import queries, suffix_dedup


def brute(rows, length=100):
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: d[:2])
    seen, results = set(), {}
    for has, i, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw) + 1)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        left = bytes(c for c, g in zip(raw, gone, strict=False) if not g)
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(raw)))
        results[i if has else None, t] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return Counter((i, *results[i, t or ""]) for i, t in rows)


def same(df, rows):
    got = Counter(tuple(r) for r in df.collect())
    assert got == brute(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    same(queries.op9_suffix_dedup(spark, sf), [(r.doc_id, r.text) for r in docs])


def test_edge_cases(spark, nasty, nasty_rows, empty):
    # different texts with one id have an order of their own, so ids are unique but for repeated rows
    same(suffix_dedup.repeats(nasty.filter("doc_id is not null or text is not null")), [r[:2] for r in nasty_rows if r[:2] != (None, None)])
    assert suffix_dedup.repeats(empty).count() == 0


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda k=6: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, k)))
    passages = [" ".join(word() for _ in range(rng.randrange(20, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([" ".join(word() for _ in range(rng.randrange(0, 60))), rng.choice(passages)[rng.randrange(30) :], "z" * rng.randrange(0, 300)]) for _ in range(rng.randrange(0, 5))]
        rows.append((i * 7 % n, "".join(parts)))
    return rows


@pytest.mark.parametrize("hot", [4096, 2, 1])
def test_made_up_matches(spark, hot):
    rows = made(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(suffix_dedup.repeats(df, hot=hot), rows)


def twice(seed):
    """The document with the lowest id has one passage twice, in different contexts; others have it once."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 8)))
    context = lambda: " ".join(word() for _ in range(rng.randrange(10, 30)))
    passage = "".join(word() + " " for _ in range(60))[: rng.randrange(105, 180)]
    return [(0, context() + passage + context() + passage + context()), *((i, context() + passage + context()) for i in range(1, 4))]


def test_the_earliest_place_stays_on_the_hot_path(spark):
    rows = [(seed * 10 + i, t) for seed in range(40) for i, t in twice(seed)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffix_dedup.repeats(df, hot=1), rows)


def test_a_long_text_in_pieces():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.segments(raw, np.array([0, len(raw)]))
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(whole[1], whole[2], strict=True)])
    assert (covered == np.arange(5000 - 99)).all() and whole[2].max() <= 69


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    part = rng.integers(97, 110, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 110, k).astype(np.uint8), part, rng.integers(97, 110, 50).astype(np.uint8)]) for k in (0, 13, 200)]
    anchors = []
    for t, k in zip(texts, (0, 13, 200), strict=True):
        _, lo, n, anchor, *_ = suffix_dedup.segments(t, np.array([0, len(t)]))
        own = np.repeat(anchor, n)
        anchors.append(own[k : k + 301])
    assert (anchors[0] == anchors[1]).all() and (anchors[0] == anchors[2]).all()


def test_smaller_before():
    rng = np.random.default_rng(6)
    for values in (np.zeros(0, np.int64), np.arange(9), np.arange(9)[::-1], *(rng.permutation(n) for n in (1, 2, 50, 3000))):
        want, stack = [], []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] > v:
                stack.pop()
            want.append(stack[-1] if stack else -1)
            stack.append(i)
        assert suffix_dedup.smaller_before(values).tolist() == want


@pytest.mark.parametrize("text", [b"aaaaaaaa", b"abracadabra abracadabra", b"banana", bytes(random.Random(1).choices(b"ab", k=200)), bytes(random.Random(2).choices(b"a\0", k=200))])
def test_repeated_windows(text):
    factor = [max((n for n in range(len(text) - p + 1) if text.find(text[p : p + n]) < p and n), default=0) for p in range(len(text))]
    for length in (1, 3, 5, 8):
        if len(text) >= length:
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
            assert suffix_dedup.repeated_windows(windows).tolist() == [f >= length for f in factor[: len(windows)]]


def test_oracle_on_made_up_matches(spark):
    import duckdb
    import pyarrow as pa

    from affinis.llm.oracles import OP9

    rows = [*made(3), (1000, None), (1001, ""), (1002, "z" * 99)]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({OP9})").fetchall())


def test_merged():
    got = suffix_dedup.merged(np.array([5, 0, 2, 20]), np.array([9, 3, 5, 21]))
    assert got.tolist() == [[0, 9], [20, 21]]
