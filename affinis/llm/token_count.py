"""Token counts of whole texts, huge documents by overlap resynchronisation.

A document up to `chunk` characters is encoded at once.  A longer one is cut into chunks that overlap; chunks
are dealt over the cluster and encoded with offsets.  Two neighbours are spliced inside their overlap at a
position that is proven to start a token in the encoding of the whole text: one where white space follows a
character that is none.  The tokenizer's pieces never go on across such a position, and what it does from there
depends on the text from there only.  Where an overlap has no such position it is widened until it has one or
the chunks become one.  The offsets of both encodings must show a token start there; a document for which
they don't is encoded again with wider overlaps, in the end as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import durable, lean, shuffle_parts, small_batches
from affinis.llm.tokens import piece_counter, tokenizer, tokenizer_path

CHUNK, OVERLAP = 32_768, 512
#: White space after a character that is none.
STABLE = re.compile(r"(?<=\S)\s")


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP, stable: re.Pattern = STABLE) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first, last): encode [start, end), count the tokens that start in [first, last)."""
    n, start, first = len(text), 0, 0
    while True:
        end, width = min(start + size, n), overlap
        while end < n:
            m = stable.search(text, max(first + 1, end - width), end)
            # a position needs text behind it in this chunk, and its own chunk before it
            if m and m.start() < end - 1:
                break
            end = min(end + width, n)
            width *= 2
        if end >= n:
            yield start, n, first, n
            return
        cut = m.start()
        yield start, end, first, cut
        # the next chunk begins before the cut, within the overlap
        start, first = max(start + 1, min(cut - 1, end - overlap)), cut


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [n for lo in range(0, len(texts), 256) for n in counter.count(texts[lo : lo + 256])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _cut(size: int, overlap: int, stable: re.Pattern):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(4)):
                text = text.as_py()
                out = [(text[a:b], first - a, last - a, b == len(text)) for a, b, first, last in chunks(text, size, overlap, stable)]
                for lo in range(0, len(out), 64):
                    part = out[lo : lo + 64]
                    n = len(part)
                    same = [batch.column(c)[k : k + 1].take(pa.array([0] * n)) for c in range(4)]
                    cols = [pa.array(x) for x in zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(lo, lo + n)), *cols], ["row", "id", "n_bytes", "hash", "no", "text", "first", "last", "ends"])

    return run


def _token_at(encoding, place: int) -> int | None:
    """The token that starts at a character, None if none does."""
    if place == 0:
        return 0
    token = encoding.char_to_token(place)
    return token if token is not None and encoding.token_to_chars(token)[0] == place else None


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            counts, good = [], []
            firsts, lasts, ends = (batch.column(k).to_pylist() for k in (5, 6, 7))
            for lo in range(0, batch.num_rows, 32):
                texts = batch.column(4)[lo : lo + 32].to_pylist()
                for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False), lo):
                    a, b = _token_at(e, firsts[k]), len(e) if ends[k] else _token_at(e, lasts[k])
                    good.append(a is not None and b is not None)
                    counts.append(b - a if good[-1] else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(counts, pa.int64()), pa.array(good)], ["row", "id", "n_bytes", "hash", "n", "aligned"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_name: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 1024, stable: re.Pattern = STABLE) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Counts are those of the library for the whole text, without begin, end or added tokens.  A null text is
    empty and has no tokens.  Rows with equal or null ids are counted each for itself.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path(tokenizer_name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.filter(F.length("text") <= chunk).mapInArrow(lean(_whole(path)), "id long, n_bytes long, n_tokens long")
    # a row's own number keeps rows with equal ids apart; rows to encode again are known by id and text
    left = rows.filter(F.length("text") > chunk).withColumn("hash", F.xxhash64("text"))
    parts, key = shuffle_parts(spark), "row long, id long, n_bytes long, hash long"
    while True:
        numbered = left.select(F.monotonically_increasing_id().alias("row"), "id", "n_bytes", "hash", "text")
        cut = numbered.mapInArrow(lean(_cut(chunk, overlap, stable)), f"{key}, no long, text string, first long, last long, ends boolean")
        dealt = cut.repartition(parts, "row", "no").drop("no")
        coded = dealt.mapInArrow(lean(_encode(path)), f"{key}, n long, aligned boolean")
        counted = durable(coded.groupBy("row", "id", "n_bytes", "hash").agg(F.sum("n").alias("n_tokens"), F.bool_and("aligned").alias("aligned")))
        out = out.unionByName(counted.filter("aligned").select("id", "n_bytes", "n_tokens"))
        bad = counted.filter(~F.col("aligned")).select(F.col("id").alias("i"), F.col("hash").alias("h"))
        if bad.isEmpty():
            break
        left = left.join(bad, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left_semi")
        chunk, overlap = chunk * 4, overlap * 8  # wider, and at last the whole text
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
