"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort per partition places equal texts
next to each other, and neighbours are compared in full.  The splitters are made of a bounded prefix, a hash
of the whole text and the identifier, so their size does not depend on the texts and a group of copies of any
size spreads over as many ranges as it needs.  A run of equals can then only go on across a border of ranges;
the first and the last run of each range (two texts a partition) are matched in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from affinis.llm.common import ascii_lower, durable, ids_back, ids_of, lean, shuffle_parts, small_batches, stored

#: Characters of the text in a splitter.
PREFIX = 48
SCHEMA = "id long, keep_id long, group_size long, text_sha256 string, run long, edge boolean, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text and falling id -> the rows with their run.  Holds the ids of one run, never its texts."""
    base = TaskContext.get().partitionId() << 32
    count = 0
    text, held = None, []  # of the run that may go on

    def closed(edge: bool) -> pa.RecordBatch:
        nonlocal count
        ids = np.concatenate(held)
        n = len(ids)
        raw = text.as_py()
        out = [
            ids_back(ids),
            ids_back(np.full(n, ids[0])),
            pa.array(np.full(n, n)),
            pa.array([hashlib.sha256(raw.encode()).hexdigest()] * n),
            pa.array(np.full(n, base + count)),
            pa.array(np.full(n, edge)),
            pa.array([raw if edge else None] + [None] * (n - 1), pa.string()),
        ]
        count += 1
        return pa.RecordBatch.from_arrays(out, ["id", "keep_id", "group_size", "text_sha256", "run", "edge", "edge_text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = ids_of(batch.column(0)), batch.column(1)
        differs = np.ones(len(ids), bool)
        differs[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        differs[0] = text is None or not text.equals(texts[0])
        starts = np.flatnonzero(differs)
        if not len(starts):
            held.append(ids)
            continue
        if text is not None:
            if starts[0]:
                held.append(ids[: starts[0]])
            yield closed(edge=count == 0)
        if len(starts) > 1:  # runs that begin and end in this batch
            s, e = starts[:-1], starts[1:]
            sizes = e - s
            shas = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.take(pa.array(s))]
            numbers = base + count + np.arange(len(s))
            first = np.zeros(len(s), bool)
            first[0] = count == 0
            lo, hi = s[0], e[-1]
            edges = np.repeat(first, sizes)
            edge_texts = [None] * int(hi - lo)
            if first[0]:
                edge_texts[0] = texts[int(lo)].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    ids_back(ids[lo:hi]),
                    ids_back(np.repeat(ids[s], sizes)),
                    pa.array(np.repeat(sizes, sizes)),
                    pa.array(shas).take(pa.array(np.repeat(np.arange(len(s)), sizes))),
                    pa.array(np.repeat(numbers, sizes)),
                    pa.array(edges),
                    pa.array(edge_texts, pa.string()),
                ],
                ["id", "keep_id", "group_size", "text_sha256", "run", "edge", "edge_text"],
            )
            count += len(s)
        text, held = texts[int(starts[-1])], [ids[starts[-1] :]]
    if text is not None:
        yield closed(edge=True)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z become a-z; a null text counts as empty.  The row with the largest
    id of a group stays; a null id is smaller than any other, and of rows with the same largest id each is marked
    as kept, since ids are taken to be unique.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or shuffle_parts(spark)
    norm = docs.select(F.col(id_col).cast("long").alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    keyed = norm.select("id", "norm", F.substring("norm", 1, PREFIX).alias("p"), F.xxhash64("norm").alias("h"))
    dealt = keyed.repartitionByRange(n, "p", "h", F.col("id").desc_nulls_last())
    sorted_ = dealt.sortWithinPartitions("p", "h", "norm", F.col("id").desc_nulls_last())
    rows = durable(sorted_.select("id", "norm").mapInArrow(lean(_runs), SCHEMA))
    edges = rows.filter(F.col("edge_text").isNotNull())
    groups = edges.groupBy("edge_text").agg(F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
    joined = edges.select("run", "edge_text").join(groups, "edge_text").select("run", "all_keep", "all_size")
    inner = rows.filter(~F.col("edge")).select("id", "keep_id", "group_size", "text_sha256")
    outer = rows.filter("edge").join(joined, "run").select("id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), "text_sha256")
    out = inner.unionByName(outer)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, hash, text) sorted by text -> the first row of each run; edge marks the first and last run of the range."""
    base, count = TaskContext.get().partitionId() << 32, 0
    last, held = None, None  # (hash, normalised text) and row of the run that may go on

    def out(rows: pa.Array, edge: bool) -> pa.RecordBatch:
        nonlocal count
        n = len(rows)
        count += n
        return pa.RecordBatch.from_arrays([rows, pa.array(np.full(n, edge)), pa.array(base + np.arange(count - n, count))], ["row", "edge", "place"])

    for batch in batches:
        rows, hashes, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        first = []
        for i in range(batch.num_rows):
            # texts are compared in full where their hashes agree
            text = None
            if last is not None and hashes[i] == last[0]:
                text = _normal(texts[i])
                if last[1] is None:
                    last = last[0], _normal(last[2]), None
                if text == last[1]:
                    continue
            last = hashes[i], text, texts[i]
            first.append(i)
        if not first:
            continue
        own = rows.take(pa.array(first))
        if held is not None:
            yield out(held, count == 0)
        if len(own) > 1:
            if held is None:
                yield out(own[:1], True)
            if len(own) > 1 + (held is None):
                yield out(own[int(held is None) : -1], False)
        held = own[-1:]
    if held is not None:
        yield out(held, True)


_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _normal(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes().translate(_NORMAL) if text.is_valid else b""


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group of equal texts, the one with the largest id, with the columns of docs.

    Whole rows travel through the content sort, once, so nothing is joined by id: of rows that share the largest id
    (whole-row repeats among them) one stays, null ids come after all others, and clashing names do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = ascii_lower(text)
    keyed = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.substring(norm, 1, PREFIX).alias("p"), F.xxhash64(norm).alias("h"))
    dealt = keyed.repartitionByRange(shuffle_parts(spark), "p", "h", F.col("id").desc_nulls_last())
    inner = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    # equal prefix and hash mean equal texts but for collisions, which are kept apart by the text itself
    sorted_ = dealt.sortWithinPartitions("p", "h", ascii_lower(inner), F.col("id").desc_nulls_last())
    found = sorted_.select("row", "h", inner.alias("text")).mapInArrow(lean(_first_of_runs), StructType([StructField("row", sorted_.schema["row"].dataType), StructField("edge", BooleanType()), StructField("place", LongType())]))
    rows = stored(found, "first")
    # runs that go over a border of ranges: two rows a partition
    edges = rows.filter("edge").withColumns({"id": F.col("row").getField(id_col).cast("long"), "norm": ascii_lower(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")))})
    best = edges.withColumn("turn", F.row_number().over(Window.partitionBy("norm").orderBy(F.col("id").desc_nulls_last(), "place"))).filter("turn = 1")
    return rows.filter("not edge").select("row.*").unionByName(best.select("row.*"))
