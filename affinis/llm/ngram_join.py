"""N-gram Jaccard join by MinHash banding.

The numbers of bands and rows are chosen for a target recall at the threshold.  Texts with the same words are one
node.  Nodes are shuffled on band hashes; each bucket gives edges to its smallest node only, and the connected
buckets are the candidate groups.  Within a group all pairs are verified on their full n-gram sets, a group of
many nodes in tiles that are dealt over the cluster.  What leaves a tile is a count of links and one edge for
each node, never a row for each pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import durable, lean, mix64, prefix_sums, range_hashes, shuffle_parts, slices, small_batches, text_bytes, words_of
from affinis.llm.components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Most hash functions; more rows a band mean fewer false candidates.
HASHES = 160
#: Nodes in one side of a tile.
TILE = 256
NO_ID = (1 << 63) - 1


def bands_for(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which 1 - (1 - t**rows)**bands reaches the recall within the hashes."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold < 1 else 1, 1)
    for rows in range(2, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            best = bands, rows
    return best


@functools.cache
def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


@functools.cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row's words, offsets by row, and the words' hashes with their offsets in a pair.

    A-Z count as a-z.  A row with fewer words than n has one n-gram of all its words, one without words has none.
    """
    low = _lower()[buf]
    starts, ends, at = words_of(low, offsets)
    words = range_hashes(prefix_sums(low), starts, ends)
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    where = np.concatenate([[0], np.cumsum(grams)])
    first = np.repeat(at[:-1], grams) + np.arange(where[-1]) - np.repeat(where[:-1], grams)
    size = np.repeat(np.minimum(count, n), grams)
    factor = _odd(n + 1, 3)
    out = words[first] * factor[0] + factor[n] * size.astype(np.uint64)
    for k in range(1, n):
        part = words[np.minimum(first + k, max(len(words) - 1, 0))] * factor[k]
        part[size <= k] = 0
        out += part
    return mix64(out), where, (words, at)


def _sequence_hash(words: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each row's sequence of words."""
    total = np.zeros(len(words) + 1, np.uint64)
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    np.cumsum(mix64(words + mix64(place.astype(np.uint64) + _odd(2, seed)[0])), out=total[1:])
    return mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * _odd(2, seed)[1])


def _signatures(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, mixers = _odd(bands * rows, 17), _odd(rows, 19)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(2))
            size = batch.num_rows
            keys, count = np.zeros((size, 2), np.int64), np.zeros(size, np.int64)
            value = np.zeros((size, bands), np.uint64)
            for lo, hi in slices(offsets, 1 << 18):
                grams, where, (words, at) = shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                keys[lo:hi, 0] = _sequence_hash(words, at, 23).view(np.int64)
                keys[lo:hi, 1] = _sequence_hash(words, at, 29).view(np.int64)
                count[lo:hi] = np.diff(at)
                some = np.flatnonzero(np.diff(where))
                if not len(some):
                    continue
                room = np.empty_like(grams)
                for b in range(bands):
                    acc = np.zeros(len(some), np.uint64)
                    for r in range(rows):
                        np.multiply(grams, factors[b * rows + r], out=room)
                        acc += mix64(np.minimum.reduceat(room, where[:-1][some]) + mixers[r])
                    value[lo + some, b] = mix64(acc)
            flat = pa.array(value.view(np.int64)[count > 0].ravel())
            at_ = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(count), pa.ListArray.from_arrays(pa.array(at_), flat)], ["id", "text_hash", "a", "b", "n_words", "bands"])

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether left set i and right set j reach the threshold, on the full sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):  # a bounded part of the n-grams at a time
        a, b = np.searchsorted(column, (lo, lo + 4096))
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], column[a:b] - lo] = 1
        both += table[left] @ table[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-9


def _verify_group(key: tuple, nodes: np.ndarray, tiles: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node within a tile, and the smallest node that it is connected with there."""
    _, i, j = key
    left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
    links, root = np.zeros(len(nodes), np.int64), nodes.copy()
    if not len(left) or not len(right):
        return links, root
    hit = _links(sets, left, right, threshold)
    if i == j:
        np.fill_diagonal(hit, False)
        links[left] = hit.sum(axis=1)
    else:
        links[left], links[right] = hit.sum(axis=1), hit.sum(axis=0)
    while True:  # smallest node over links, until nothing changes
        before = root.copy()
        big = np.iinfo(np.int64).max
        root[left] = np.minimum(root[left], np.where(hit, root[right][None, :], big).min(axis=1))
        root[right] = np.minimum(root[right], np.where(hit, root[left][:, None], big).min(axis=0))
        if (root == before).all():
            return links, root


def _verify(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def done() -> pa.RecordBatch:
            nodes = np.array([h[0] for h in held])
            links, root = _verify_group(held_key, nodes, np.array([h[1] for h in held]), [h[2] for h in held], threshold)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(root), pa.array([held[0][3]] * len(nodes))], ["node", "links", "root", "tiled"])

        for batch in batches:
            group, i, j, node, tile, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            buf, offsets = text_bytes(batch.column(6))
            for lo, hi in slices(offsets, 1 << 20):
                grams, where, _ = shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                for x in range(lo, hi):
                    key = group[x], i[x], j[x]
                    if key != held_key:
                        if held:
                            yield done()
                        held_key, held = key, []
                    if held and held[-1][0] == node[x]:
                        continue  # a repeated row
                    held.append((node[x], tile[x], np.unique(grams[where[x - lo] : where[x - lo + 1]]), bool(k[x] > 1)))
        if held:
            yield done()

    return run


#: Bits of the filter for texts that are needed, a power of two.
FILTER = 1 << 25


def _places(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes.view(np.uint64)) % np.uint64(FILTER)).astype(np.int64)


def _bits(hashes: DataFrame) -> bytes:
    """A bit for each hash, in a filter of fixed size that is sent to all; 4 MB however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for batch in batches:
            bits[_places(batch.column(0).to_numpy())] = True
        parts = np.packbits(bits).reshape(16, -1)
        some = [k for k in range(16) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["k", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(bits.as_buffer(), np.uint8)
                held[k] = held[k] | own if k in held else own.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["k", "bits"])

    out = np.zeros((16, FILTER // 128), np.uint8)
    for r in hashes.mapInArrow(lean(run), "k long, bits binary").repartition(16, "k").mapInArrow(lean(merge), "k long, bits binary").collect():
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _maybe(shared):
    """Rows whose text_hash has its bit: all that are wanted and some that are not, which the join drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = _places(batch.column(1).to_numpy())
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))

    return run


def _keys(id_col: str, text_col: str) -> list[Column]:
    """id (a null one larger than any other) and text_hash of a row."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")]


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, n: int) -> DataFrame:
    """id and text_hash of each row, those of its class's first text, n_links and n_copies."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = bands_for(threshold, recall)
    base = docs.select(*_keys(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = base.mapInArrow(lean(_signatures(bands, rows, n)), "id long, text_hash long, a long, b long, n_words long, bands array<long>")
    signed = durable(signed)
    worded = signed.filter("n_words > 0")
    grouped = worded.groupBy("a", "b").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    nodes = durable(grouped.select(F.monotonically_increasing_id().alias("node"), "a", "b", F.col("least.id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "n_copies", "bands"))

    dealt = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    # what is summed by a key is stored before it is joined by that key, so that a hot key's rows can be split
    buckets = durable(dealt.groupBy("band", "value").agg(F.min("node").alias("least"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    star = dealt.join(buckets, ["band", "value"]).filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    groups = durable(components(star).withColumnRenamed("root", "group_"))
    sizes = durable(groups.groupBy("group_").agg(F.count("*").alias("m")))
    placed = groups.join(sizes, "group_").withColumn("k", F.ceil(F.col("m") / TILE).cast("long")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k")))
    members = durable(placed.join(nodes.select("node", "rep", "rep_hash"), "node").select("node", "group_", "k", "tile", "rep", "rep_hash"))
    wanted = base.mapInArrow(lean(_maybe(spark.sparkContext.broadcast(_bits(members.select("rep_hash"))))), "id long, text_hash long, text string")
    texts = members.join(wanted, (F.col("rep") == F.col("id")) & (F.col("rep_hash") == F.col("text_hash"))).select("node", "group_", "k", "tile", "text")
    tiles = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    tiles = tiles.select("group_", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "tile", "k", "text")
    by_tile = tiles.repartition(shuffle_parts(spark), "group_", "i", "j").sortWithinPartitions("group_", "i", "j", "node")
    found = durable(by_tile.mapInArrow(lean(_verify(threshold, n)), "node long, links long, root long, tiled boolean"))

    tiled = found.filter("tiled")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    if not tiled.isEmpty():  # the tiles of a large group are joined by their edges
        joined = components(tiled.select(F.col("node").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("n"), F.col("root").alias("all"))
        links = links.join(joined, F.col("node") == F.col("n"), "left").select("node", "n_links", F.coalesce("all", "root").alias("root"))
    known = durable(nodes.drop("bands").join(links, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = durable(known.groupBy("root").agg(F.min(F.struct("rep", "rep_hash")).alias("first")))
    named = known.join(classes, "root").select("a", "b", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    out = worded.select("id", "text_hash", "a", "b").join(named, ["a", "b"]).select("id", "text_hash", F.col("first.rep").alias("class_id"), F.col("first.rep_hash").alias("class_hash"), "n_links", "n_copies")
    bare = signed.filter("n_words = 0").select("id", "text_hash", F.col("id").alias("class_id"), F.col("text_hash").alias("class_hash"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(bare)




def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """id, class_id, n_links and n_copies of each row.

    Two texts are linked when the Jaccard index of their sets of word n-grams is the threshold or more.  A class is
    a connected group; its id is the smallest document id in it.  n_links counts the different texts (as sequences
    of words, A-Z as a-z) that a document's text is linked with, n_copies the rows with its sequence, itself
    included.  A text without words, so a null or empty one, has no n-gram: it is a class of its own with no link.
    A null id is larger than any other.  Repeated rows are copies.  Other columns are ignored.
    """
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _classes(docs, id_col, text_col, threshold, recall, n).select(back("id").alias(id_col), back("class_id").alias("class_id"), "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """One row of docs of each class, the one with the smallest id, with the columns of docs.

    Of rows with equal id and text (whole-row repeats among them) one stays; a null id is larger than any other.  A
    text without words is a class of its own, so one row of each id that has it stays.  Names of columns may clash with
    any that are used here: rows travel as one struct.
    """
    first = _classes(docs, id_col, text_col, threshold, recall, n).filter("id = class_id and text_hash = class_hash").select("id", "text_hash").distinct()
    rows = docs.select(*_keys(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = Window.partitionBy("id", "text_hash").orderBy(F.lit(0))
    kept = rows.join(first, ["id", "text_hash"], "left_semi").withColumn("turn", F.row_number().over(one)).filter("turn = 1")
    return kept.select("row.*")
