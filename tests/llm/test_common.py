"""Byte arrays, hashes and the shared folder."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.llm import common


def laid_out(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


@pytest.mark.parametrize("texts", [["a b", "", " c\n", "d"], [""], ["   ", "x"], ["é  \x0bü", "a"], ["ab", "cd"]])
def test_words(texts):
    buf, off = laid_out(texts)
    start, end, at = common.words_of(buf, off)
    got = [bytes(buf[a:b]).decode() for a, b in zip(start, end, strict=True)]
    want = [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]
    assert [got[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_range_hashes_depend_on_bytes_only():
    buf, _ = laid_out(["abcXabcYabd" * 40])
    start = np.arange(0, 430)
    hashes = common.range_hashes(common.prefix_sums(buf), start, start + 3)
    seen = {}
    for s, h in zip(start, hashes, strict=True):
        assert seen.setdefault(bytes(buf[s : s + 3]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_text_bytes_of_a_slice_with_nulls():
    column = pa.array(["one", None, "", "drei", "vier"])[1:4]
    buf, off = common.text_bytes(column)
    assert bytes(buf) == b"drei" and off.tolist() == [0, 0, 0, 4]
    assert common.text_bytes(pa.array([], pa.string()))[1].tolist() == [0]


def test_slices_cover_all_rows():
    off = np.array([0, 5, 5, 30, 31, 40])
    assert list(common.slices(off, 10)) == [(0, 2), (2, 3), (3, 5)]


def test_even_keys_reach_every_partition(spark):
    keys = common.even_keys(spark, 37)
    rows = spark.createDataFrame([(k,) for k in keys], "part long").repartition(37, "part")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 37


def test_stored_and_durable(spark):
    df = spark.range(10).withColumn("x", F.rand(1))
    assert sorted(common.durable(df).collect()) == sorted(common.stored(df, "t").collect())
    assert common.shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_lean_passes_batches_on_and_ends():
    batches = [pa.record_batch({"a": [1, 2]}), pa.record_batch({"a": [3]})]
    assert list(common.lean(lambda b: b)(iter(batches))) == batches
