"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An n-gram's vector binds those of its
letters: each is permuted (rotated) by its place and they are multiplied.  A document bundles, that is adds, the
vectors of all its n-grams, a language those of all its training documents, and a document is given the language
whose prototype has the largest cosine with it.

Bundling is linear, so training gathers n-gram counts per language, summed map-side first, and each prototype is
made of the sums, which are whole numbers and so the same in any order.  Counts are dealt over the cluster; what
reaches the driver is one vector a language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import crc_of_id, durable, ids_back, ids_of, lean, mix64, shuffle_parts, slices, small_batches, text_bytes

DIMENSIONS, N, SEED = 1024, 3, 11
#: Bits of a code point; an n-gram is a number of N of them, first letter highest.
POINT = 21
#: Prototypes are broadcast; languages beyond this are an error, not a cut.
MAX_LANGUAGES = 2_000


@functools.cache
def letters() -> np.ndarray:
    """Code point -> letter: 0 for all but letters, else the code point of its small letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 a letter, drawn from its code point; the blank between words, 0, has a vector as well."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED << 32)
    bits = mix64(mix64(points.astype(np.uint64) + np.uint64(1))[:, None] ^ mix64(words)[None, :])
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams."""
    points = np.stack([grams >> (POINT * (N - 1 - place)) & ((1 << POINT) - 1) for place in range(N)])
    known, at = np.unique(points, return_inverse=True)
    base, at, out = letter_vectors(known), at.reshape(points.shape), np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(N):
        out *= np.roll(base, N - 1 - place, axis=1)[at[place]]
    return out


def symbols_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, runs of other characters as one blank, a blank at each end; and their offsets."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
    b0 = buf[lead].astype(np.int64)
    cp = b0.copy()
    for size, mask, low in ((2, 0x1F, 0xC0), (3, 0x0F, 0xE0), (4, 0x07, 0xF0)):
        at = np.flatnonzero((b0 >= low) & (b0 < (low | mask) + 1))
        if len(at):
            v = b0[at] & mask
            for k in range(1, size):
                v = v << 6 | (buf[lead[at] + k] & 0x3F)
            cp[at] = v
    symbols = letters()[cp]
    starts = np.searchsorted(lead, offsets)
    n = len(offsets) - 1
    # a blank before each text and one after the last
    out = np.zeros(len(symbols) + n + 1, np.int32)
    out[np.arange(len(symbols)) + np.repeat(np.arange(1, n + 1), np.diff(starts))] = symbols
    first = starts[:-1] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[first] = True
    kept = np.flatnonzero(keep)
    return out[kept], np.append(np.searchsorted(kept, first), len(kept) - 1)


def gram_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) for each n-gram of each text, blanks at the ends included; texts without letters have none."""
    symbols, at = symbols_of(buf, offsets)
    n = len(at) - 1
    if len(symbols) < N:
        return (np.zeros(0, np.int64),) * 3
    # the letters met here are numbered, so that a text and an n-gram fit one number
    met = np.zeros(0x110000, bool)
    met[symbols] = True
    met[0] = True
    points = np.flatnonzero(met)
    number = np.cumsum(met) - 1
    symbols, many = number[symbols], len(points)
    if many**N > (1 << 62) // max(n, 1):  # more letters than any real slice has
        parts = [gram_counts(buf[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k]) for k in range(n)] if n > 1 else []
        if parts:
            return np.concatenate([np.full(len(p[0]), k) for k, p in enumerate(parts)]), *(np.concatenate([p[c] for p in parts]) for c in (1, 2))
    codes = np.zeros(len(symbols) - N + 1, np.int64)
    for k in range(N):
        codes = codes * many + symbols[k : len(symbols) - N + 1 + k]
    text = np.repeat(np.arange(n), np.diff(at))[: len(codes)]
    # an n-gram ends with its text's last blank, which the next text shares
    inside = np.arange(len(codes)) + N - 1 <= at[1:][text]
    key, count = np.unique(text[inside] * many**N + codes[inside], return_counts=True)
    text, local = key // many**N, key % many**N
    gram = np.zeros(len(local), np.int64)
    for k in range(N):
        gram = gram << POINT | points[local // many ** (N - 1 - k) % many]
    real = gram & ((1 << POINT * (N - 1)) - 1) > 0  # more than blanks
    return text[real], gram[real], count[real]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed over what the task has read so far."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        buf, offsets = text_bytes(batch.column(1))
        for lo, hi in slices(offsets, 1 << 20):
            text, gram, n = gram_counts(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for lang in set(langs[lo:hi]):
                mine = langs[lo:hi][text] == lang
                g, c = gram[mine], n[mine]
                if lang in held:
                    g, c = np.concatenate([held[lang][0], g]), np.concatenate([held[lang][1], c])
                grams, where = np.unique(g, return_inverse=True)
                held[lang] = grams, np.bincount(where, c, len(grams)).astype(np.int64)
        if sum(len(g) for g, _ in held.values()) > 2_000_000:
            yield from out()
    yield from out()


def train(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in code point order, and the unit prototype of each."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = durable(rows.mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, grams, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs):
                mine = langs == lang
                for lo in range(0, int(mine.sum()), 4096):
                    part = n[mine][lo : lo + 4096].astype(np.float64) @ gram_vectors(grams[mine][lo : lo + 4096]).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(v.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    kind = "lang string, v binary"
    parts = counts.mapInArrow(lean(bundle), kind).repartition(shuffle_parts(docs.sparkSession), "lang").mapInArrow(lean(merge), kind)
    found = {r["lang"]: np.frombuffer(r["v"], np.float64) for r in parts.limit(MAX_LANGUAGES + 1).collect()}  # one row a language
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(found, key=lambda x: x.encode("utf-32-be"))
    out = np.stack([found[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, (out / np.where(norm, norm, 1)).astype(np.float32)


class _Vectors:
    """Vectors of the n-grams met so far, as rows of one matrix; bounded, since the memo is dropped when full."""

    MOST = 40_000

    def __init__(self):
        self.known, self.matrix = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int8)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """float32 vectors of sorted distinct n-grams."""
        at = np.searchsorted(self.known, grams)
        new = grams[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != grams)] if len(self.known) else grams
        if len(new):
            if len(self.known) + len(new) > self.MOST:
                self.known, self.matrix = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int8)
                new = grams
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.known, self.matrix = known[order], np.concatenate([self.matrix, gram_vectors(new)])[order]
        return self.matrix[np.searchsorted(self.known, grams)].astype(np.float32)


def _predict(langs: list[str], prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, names = _Vectors(), np.array([*langs, "und"], object)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            n = batch.num_rows
            best, score = np.full(n, len(langs)), np.zeros(n)
            for lo, hi in slices(offsets, 1 << 20) if langs else ():
                hi_ = min(hi, lo + 512)
                for a in range(lo, hi, 512):
                    hi_ = min(hi, a + 512)
                    text, gram, count = gram_counts(buf[offsets[a] : offsets[hi_]], offsets[a : hi_ + 1] - offsets[a])
                    if not len(text):
                        continue
                    grams, column = np.unique(gram, return_inverse=True)
                    bundle = np.zeros((hi_ - a, DIMENSIONS), np.float32)
                    for g in range(0, len(grams), 8192):  # a bounded part of the n-grams at a time
                        part = (column >= g) & (column < g + 8192)
                        table = np.zeros((hi_ - a, min(8192, len(grams) - g)), np.float32)
                        table[text[part], column[part] - g] = count[part]
                        bundle += table @ vectors.rows(grams[g : g + 8192])
                    norm = np.linalg.norm(bundle, axis=1)
                    cosine = bundle @ prototypes.T / np.where(norm, norm, 1)[:, None]
                    some = np.unique(text)
                    best[a + some] = cosine[some].argmax(axis=1)
                    score[a + some] = np.clip(cosine[some].max(axis=1).astype(np.float64), 0, 1)
            yield pa.RecordBatch.from_arrays([ids_back(ids_of(batch.column(0))), pa.array(names[best], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (the cosine, 0 to 1) of each row; `und` and 0 where a text has no letter or is null.

    Equal cosines go to the language first in code point order.  With no language learned all are `und`.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_predict(langs, prototypes)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_: Column) -> Column:
    """The documents whose crc32 modulo 4 is 2; a null id is not held out."""
    return F.coalesce(F.pmod(crc_of_id(id_), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows not held out that have a language, and predicts all: id, held_out, lang_pred, score.

    Each row is predicted by its own text, so rows with equal or null ids get a row each, and repeated ones are learned
    as often as they stand.  An empty table gives an empty result.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    langs, prototypes = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    out = predict(docs, langs, prototypes, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
