"""Exact substring dedup by longest-previous-factor arrays over a distributed sparse suffix array.

A byte goes when it is covered by a string of LENGTH bytes that also starts earlier.  Where the longest previous
factor of a position is LENGTH or more, the LENGTH bytes from there go.  In suffix order the factor is found at the
previous or next position that is smaller (repeated_windows).

The suffixes of all texts don't fit one array, so they are dealt by content.  Every window of LENGTH bytes has an
anchor, its K-gram with the least hash, and equal windows have equal anchors.  Neighbouring windows with one anchor
make a segment (about 35 windows).  Segments meet by anchor:

1. a segment whose bytes have been seen at an earlier place goes whole, first within a batch, then over all;
2. different segments with one anchor, the places where a match begins or ends, send their bytes to suffix
   arrays that are sorted by the windows' bytes and give each window's verdict.  A window reaches SIDE bytes or
   more beyond its anchor on one side at least, so a segment that shares neither side's hash with another can't
   share a window and is left out;
3. an anchor shared by more than HOT different segments is dealt by the hash of each window instead.

Windows with equal bytes thus always meet, and only bytes near the ends of matches are ever sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import HASH_INVERSE, NULL_ID, durable, even_keys, ids_of, lean, mix64, powers_for, prefix_sums, range_hashes, shuffle_parts, slices, small_batches, text_bytes

LENGTH, K = 100, 32
HOT = 4096
#: Every window has so many bytes left or right of its anchor.
SIDE = (LENGTH - K) // 2
#: Suffixes that are sorted together, about; those of one anchor always are.
TOGETHER = 200_000
#: Bytes of one text that are looked at together.
PIECE = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)


# --- arrays of one text


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the last place before it with a smaller value; -1 if there is none.

    All places look one to the left; those that see a larger value go on to where that one looks, all values between
    being larger still, until nothing moves.
    """
    out = np.arange(len(values)) - 1
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        todo = todo[values[out[todo]] > values[todo]]
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
    return out


def repeated_windows(windows: np.ndarray) -> np.ndarray:
    """Which rows of bytes, given in the order of their places, also occur at an earlier place.

    The windows are suffixes cut at their LENGTH bytes, so their longest previous factors are cut there as well.  In
    suffix order a place's factor is shared with its previous or next smaller place; it has all the bytes when one of
    these two windows is the same.
    """
    n, size = windows.shape
    keys = np.ascontiguousarray(windows).view(f"S{size}").ravel()
    order = np.argsort(keys)
    ranked = keys[order]
    before = smaller_before(order)
    after = n - 1 - smaller_before(order[::-1])[::-1]
    out = np.zeros(n, bool)
    for neighbour, real in ((before, before >= 0), (after, after < n)):
        here = np.flatnonzero(real)
        out[order[here]] |= ranked[neighbour[here]] == ranked[here]
    return out


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unions of intervals as rows (start, end), touching ones joined."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    heads = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(heads)
    return np.stack([start[at], reach[np.append(at[1:], len(start)) - 1]], axis=1).astype(np.int64)


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, content, left side, right side) of the segments of each row's windows.

    The last four are hashes; a side's is 0 where the row has not so many bytes there.
    """
    n = len(raw)
    lens = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not lens.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.uint16),) * 2
    sums = prefix_sums(raw, 41)
    grams = mix64((sums[K:] - sums[:-K]) * powers_for(HASH_INVERSE, n + 1)[: n - K + 1])
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, LENGTH - K + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: width - want], least[want - width :])
    row = np.repeat(np.arange(len(lens)), lens)
    window = np.arange(len(row)) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    anchor = (least[window] & _PLACE).astype(np.int64)
    heads = np.ones(len(row), bool)
    heads[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(heads)
    count = np.diff(np.append(at, len(row)))
    lo, anchor, row = window[at], anchor[at], row[at]
    shape = ((anchor - lo) * LENGTH + count).astype(np.uint64)
    content = mix64(range_hashes(sums, lo, lo + count - 1 + LENGTH) + shape * np.uint64(0xA24BAED4963EE407))

    def side(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = (a >= offsets[row]) & (b <= offsets[row + 1])
        h = (range_hashes(sums, np.where(inside, a, 0), np.where(inside, b, 0)) >> np.uint64(48)).astype(np.uint16)
        return np.where(inside, np.maximum(h, 1), 0).astype(np.uint16)

    return row, lo - offsets[row], count, grams[anchor], content, side(anchor - SIDE, anchor + K), side(anchor, anchor + K + SIDE)


# --- dealing segments by anchor


def _by_part(hashes: np.ndarray, keys: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) for each of the lots that some hashes fall into."""
    part = (hashes % np.uint64(len(keys))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(len(keys) + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield keys[p], order[cuts[p] : cuts[p + 1]]


def _doc_hash(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.view(np.uint64) + np.uint64(1))


def _starts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """segments of a batch's rows, long rows in pieces, rows in their order."""
    buf, offsets = text_bytes(batch.column(2))
    for lo, hi in slices(offsets, 1 << 19):
        raw, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        for a in range(0, max(len(raw), 1), PIECE) if hi == lo + 1 else (None,):
            part = raw if a is None else raw[a : a + PIECE + LENGTH - 1]
            row, start, *rest = segments(part, off if a is None else np.array([0, len(part)]))
            yield row + lo, start + (a or 0), *rest


#: anchor: the upper half of its hash; the lower gives the part.
SEGMENT = np.dtype([("anchor", "<u4"), ("content", "<u8"), ("start", "<u4"), ("doc", "<u2"), ("count", "u1"), ("left", "<u2"), ("right", "<u2")])
DEALT = "part long, id long, tie long, gone binary, ids binary, ties binary, segments binary"


def _deal(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DEALT.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ties = ids_of(batch.column(0)), batch.column(1).to_numpy()
            order = np.lexsort((ties, ids))
            batch = batch.take(pa.array(order))
            ids, ties = ids[order], ties[order]
            doc, start, count, anchor, content, left, right = (np.concatenate(x) for x in zip(*_starts(batch), strict=True))
            # the first place in this batch of each segment; the others go
            both = mix64(anchor + content * np.uint64(0x9E3779B97F4A7C15))
            by = np.argsort(both, kind="stable")
            head = np.ones(len(by), bool)
            head[1:] = both[by[1:]] != both[by[:-1]]
            first = np.empty(len(by), np.int64)
            first[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by
            same = (anchor == anchor[first]) & (content == content[first])
            again = (ids[doc] == ids[doc[first]]) & (ties[doc] == ties[doc[first]]) & (start == start[first])
            gone = same & ~again
            out = []
            for d, at in _groups(doc[gone]):
                own = np.flatnonzero(gone)[at]
                out.append((keys[int(_doc_hash(ids[d : d + 1])[0] % np.uint64(len(keys)))], int(ids[d]), int(ties[d]), merged(start[own], start[own] + count[own] - 1 + LENGTH).tobytes(), None, None, None))
            live = np.flatnonzero(~gone & ~((first != np.arange(len(first))) & same))
            for p, at in _by_part(anchor[live], keys):
                own = live[at]
                docs, place = np.unique(doc[own], return_inverse=True)
                seg = np.empty(len(own), SEGMENT)
                seg["anchor"], seg["content"], seg["start"], seg["doc"], seg["count"] = anchor[own] >> np.uint64(32), content[own], start[own], place, count[own]
                seg["left"], seg["right"] = left[own], right[own]
                out.append((p, None, None, None, ids[docs].tobytes(), ties[docs].astype(np.uint32).tobytes(), seg.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) for each value of key."""
    order = np.argsort(key, kind="stable")
    cuts = np.append(np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[order[a]]), order[a:b]


OPEN = np.dtype([("anchor", "<u8"), ("start", "<i8"), ("count", "<i4"), ("hot", "<i4")])
MARKS = "id long, tie long, gone array<binary>, open array<binary>"
#: Marks on their way to their documents: many documents to a row.
SENT = "dest long, ids array<long>, ties array<long>, gone array<binary>, open array<binary>"


def _sent(keys: list[int], ids: np.ndarray, ties: np.ndarray, gone: list, open_: list) -> pa.RecordBatch:
    rows = list(_by_part(_doc_hash(ids), keys))
    pick = lambda values, kind: pa.array([[values[k] for k in at] for _, at in rows], pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pick(ids.tolist(), pa.int64()), pick(ties.tolist(), pa.int64()), pick(gone, pa.binary()), pick(open_, pa.binary())], ["dest", "ids", "ties", "gone", "open"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a partition that has marks."""
    held: dict[tuple[int, int], tuple[list, list]] = {}
    for batch in batches:
        for ids, ties, gone, open_ in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
            for i, t, g, o in zip(ids, ties, gone, open_, strict=True):
                mine = held.setdefault((i, t), ([], []))
                if g is not None:
                    mine[0].append(g)
                if o is not None:
                    mine[1].append(o)
    keys = list(held)
    for lo in range(0, len(keys), 10_000):
        own = keys[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()), *(pa.array([held[k][c] for k in own], pa.list_(pa.binary())) for c in (0, 1))], ["id", "tie", "gone", "open"])


def _meet(lots: list[int], most: int):
    """Segments of some anchors -> for each document what goes, and which segments need the suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_parts, tie_parts, seg_parts, base = [], [], [], 0
        for batch in batches:
            kept = [], [], []
            for part, id_, tie, gone, ids, ties, segs in zip(*(batch.column(c) for c in range(7)), strict=True):
                if gone.is_valid:
                    for x, y in zip(kept, (id_, tie, gone), strict=True):
                        x.append(y.as_py())
                    continue
                seg = np.frombuffer(segs.as_buffer(), SEGMENT)
                id_parts.append(np.frombuffer(ids.as_buffer(), np.int64))
                tie_parts.append(np.frombuffer(ties.as_buffer(), np.uint32).astype(np.int64))
                seg_parts.append((seg, seg["doc"].astype(np.int64) + base, seg["anchor"].astype(np.uint64) | np.uint64(part.as_py() << 32)))
                base += len(id_parts[-1])
            if kept[0]:
                yield _sent(lots, np.array(kept[0], np.int64), np.array(kept[1], np.int64), kept[2], [None] * len(kept[0]))
        if not seg_parts:
            return
        ids, ties = np.concatenate(id_parts), np.concatenate(tie_parts)
        order = np.lexsort((ties, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (ties[order[1:]] != ties[order[:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        ids, ties = ids[order[new]], ties[order[new]]
        seg, doc, anchor = np.concatenate([s[0] for s in seg_parts]), rank[np.concatenate([s[1] for s in seg_parts])], np.concatenate([s[2] for s in seg_parts])
        by = np.lexsort((seg["start"], doc, seg["content"], anchor))
        seg, doc, anchor = seg[by], doc[by], anchor[by]
        start, count = seg["start"].astype(np.int64), seg["count"].astype(np.int64)
        other = np.ones(len(seg), bool)  # first of its content
        other[1:] = (anchor[1:] != anchor[:-1]) | (seg["content"][1:] != seg["content"][:-1])
        first = np.maximum.accumulate(np.where(other, np.arange(len(seg)), 0))
        gone = (doc != doc[first]) | (start != start[first])
        heads = np.flatnonzero(other)
        _, where, uses = np.unique(anchor[heads], return_inverse=True, return_counts=True)
        shared = np.zeros(len(heads), bool)
        for side in ("left", "right"):
            have = np.flatnonzero((uses[where] > 1) & (seg[side][heads] > 0))
            _, at, same = np.unique(mix64(anchor[heads[have]] * np.uint64(0x9E3779B97F4A7C15) + seg[side][heads[have]]), return_inverse=True, return_counts=True)
            shared[have[same[at] > 1]] = True
        open_, hot = heads[shared], (uses[where] > most)[shared]
        lost = np.flatnonzero(gone)
        marks = {}
        for d, at in _groups(doc[lost]):
            own = lost[at]
            marks[d] = [merged(start[own], start[own] + count[own] - 1 + LENGTH).tobytes(), None]
        for d, at in _groups(doc[open_]):
            own = open_[at]
            x = np.empty(len(own), OPEN)
            x["anchor"], x["start"], x["count"], x["hot"] = anchor[own], start[own], count[own], hot[at]
            marks.setdefault(d, [None, None])[1] = x.tobytes()
        keys = np.fromiter(marks, np.int64, len(marks))
        for lo in range(0, len(keys), 20_000):
            own = keys[lo : lo + 20_000]
            yield _sent(lots, ids[own], ties[own], [marks[k][0] for k in own], [marks[k][1] for k in own])

    return run


# --- the suffix arrays

STATE = "part long, id long, tie long, n_bytes long, n_removed long, n_spans long, sha string, gone binary, text binary, ids binary, ties binary, places binary, bytes binary"
PLACE = np.dtype([("doc", "<i4"), ("count", "<i4"), ("start", "<i8"), ("lot", "<u4")])


def cut(text: bytes, gone: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, runs, sha256 of what is left) for merged intervals."""
    left, at = hashlib.sha256(), 0
    for a, b in gone.tolist():
        left.update(text[at:a])
        at = b
    left.update(text[at:])
    return int((gone[:, 1] - gone[:, 0]).sum()), len(gone), left.hexdigest()


def _intervals(blobs: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
    return merged(rows[:, 0], rows[:, 1])


def _apply(keys: list[int]):
    """Texts with their marks -> finished rows (part -1), open ones (-2), and by part the bytes for its suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATE.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 6
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, ties = ids_of(batch.column(0)), batch.column(1).to_numpy()
            out, open_docs, open_segs, pieces = [], [], [], []
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                gone, todo = batch.column(3)[k].as_py() or [], batch.column(4)[k].as_py() or []
                spans = _intervals(gone)
                if not todo:
                    out.append((-1, int(ids[k]), int(ties[k]), len(text), *cut(text, spans), *[None] * 6))
                    continue
                out.append((-2, int(ids[k]), int(ties[k]), len(text), None, None, None, spans.tobytes(), pack.compress(text), *[None] * 4))
                segs = np.frombuffer(b"".join(todo), OPEN)
                raw = np.frombuffer(text, np.uint8)
                for s in segs:
                    a, n = int(s["start"]), int(s["count"])
                    step = [(a + w, 1) for w in range(n)] if s["hot"] else [(a, n)]
                    for b, m in step:
                        piece = raw[b : b + m - 1 + LENGTH]
                        key = hashlib.blake2b(piece.tobytes() if s["hot"] else s["anchor"].tobytes(), digest_size=8).digest()
                        open_docs.append(k)
                        open_segs.append((int.from_bytes(key[:4], "little"), m, b, int.from_bytes(key[4:], "little")))
                        pieces.append(piece.tobytes())
            if pieces:
                part, count, start, lot = (np.array(x, np.int64) for x in zip(*open_segs, strict=True))
                docs = np.array(open_docs)
                for p, at in _by_part(part.astype(np.uint64), keys):
                    at = at[np.lexsort((start[at], docs[at]))]  # segments come by anchor
                    own, place = np.unique(docs[at], return_inverse=True)
                    x = np.empty(len(at), PLACE)
                    x["doc"], x["count"], x["start"], x["lot"] = place, count[at], start[at], lot[at]
                    seen, keep = set(), []
                    for i, j in enumerate(at):  # of equal single windows of one text only the first is needed
                        key = (pieces[j], docs[j]) if count[j] == 1 else None
                        if key is None or key not in seen:
                            keep.append(i)
                            seen.add(key)
                        else:
                            out.append((-3, int(ids[docs[j]]), int(ties[docs[j]]), None, None, None, None, np.array([start[j], start[j] + LENGTH]).tobytes(), *[None] * 5))
                    out.append((p, *[None] * 8, ids[own].tobytes(), ties[own].tobytes(), x[keep].tobytes(), pack.compress(b"".join(pieces[j] for j in at[keep]))))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of some anchors' segments -> for each document what goes."""
    unpack = zstandard.ZstdDecompressor()
    ids, ties, places, raw, base = [], [], [], [], 0
    for batch in batches:
        for i, t, p, b in zip(*(batch.column(c) for c in range(1, 5)), strict=True):
            ids.append(np.frombuffer(i.as_buffer(), np.int64))
            ties.append(np.frombuffer(t.as_buffer(), np.int64))
            x = np.frombuffer(p.as_buffer(), PLACE).copy()
            x["doc"] += base
            base += len(ids[-1])
            places.append(x)
            raw.append(unpack.decompress(b.as_py()))
    if not places:
        return
    id_, tie, place = np.concatenate(ids), np.concatenate(ties), np.concatenate(places)
    text = np.frombuffer(b"".join(raw), np.uint8)
    del raw
    number = _document_numbers(id_, tie)  # in order
    count = place["count"].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(count - 1 + LENGTH)[:-1]])
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    found = [(np.zeros(0, np.int64),) * 2]
    lot = place["lot"] % np.uint32(count.sum() // TOGETHER + 1)
    for _, own in _groups(lot):  # equal windows are in one lot
        n = count[own]
        owner = np.repeat(own, n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        doc, start = place["doc"][owner].astype(np.int64), place["start"][owner] + step
        order = np.lexsort((start, number[doc]))  # suffixes in the order of their places
        hit = order[repeated_windows(view[(at[owner] + step)[order]])]
        found.append((doc[hit], start[hit]))
    doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = []
    for _, own in _groups(number[doc]):
        rows.append((int(id_[doc[own[0]]]), int(tie[doc[own[0]]]), merged(start[own], start[own] + LENGTH).tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "tie", "gone"])


def _document_numbers(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([ids, ties], axis=1), axis=0, return_inverse=True)[1].ravel()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for text, gone, more in zip(*(batch.column(c) for c in (2, 3, 4)), strict=True):
            text = unpack.decompress(text.as_py())
            out.append((len(text), *cut(text, _intervals([gone.as_py(), *(more.as_py() or [])]))))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "tie", "n_bytes", "n_removed", "n_spans", "sha"])


def _tie(text: Column) -> Column:
    """Tells texts with one id apart."""
    return F.xxhash64(F.lit(LENGTH), text).bitwiseAND(0x7FFFFFFF)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes) of each row.

    Texts are read as UTF-8 bytes, a null one as empty; matches stay within documents, and strings are judged on
    the input.  Smaller ids come first, a null id before all; different texts with one id are in an order of their
    own, and rows with equal id and text are one document with one result, given for each.  A text of fewer than
    LENGTH bytes loses nothing.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, "16m")  # a segment leaves a batch once
    parts = shuffle_parts(spark)
    keys = even_keys(spark, parts)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("id"), _tie(text).alias("tie"), text.cast("binary").alias("text"))
    dealt = rows.mapInArrow(lean(_deal(keys)), DEALT)
    met = dealt.repartition(parts, "part").mapInArrow(lean(_meet(keys, hot)), SENT)
    marks = met.repartition(parts, "dest").mapInArrow(lean(_gather), MARKS)
    marked = rows.join(marks, ["id", "tie"], "left").select("id", "tie", "text", "gone", "open")
    state = durable(marked.mapInArrow(lean(_apply(keys)), STATE))
    sent = state.filter("part >= 0").repartition(parts, "part").select("part", "ids", "ties", "places", "bytes")
    found = sent.mapInArrow(lean(_sort_suffixes), "id long, tie long, gone binary").unionByName(state.filter("part = -3").select("id", "tie", "gone"))
    more = found.groupBy("id", "tie").agg(F.collect_list("gone").alias("more"))
    pending = state.filter("part = -2").select("id", "tie", "text", "gone")
    kinds = "id long, tie long, n_bytes long, n_removed long, n_spans long, sha string"
    finished = pending.join(more, ["id", "tie"], "left").select("id", "tie", "text", "gone", "more").mapInArrow(lean(_finish), kinds)
    out = state.filter("part = -1").select("id", "tie", "n_bytes", "n_removed", "n_spans", "sha").unionByName(finished)
    id_ = F.when(F.col("id") != int(NULL_ID), F.col("id"))
    return out.select(id_.alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))
