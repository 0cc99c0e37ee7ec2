"""Packing by vector bin packing.

Examples are placed under three limits at once: tokens, segments and loss-bearing tokens of a sequence.  A bin
takes the example whose needs have the largest dot product with what the bin has left, each in shares of its
limit, until none fits; an example is then cut to fill a gap that is worth it.  Each task packs what it reads,
so nothing is shuffled.  A sequence that another limit closes far from full, and a task's last ones, are cut at powers
of two, where no padding is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import ids_back, ids_of, lean, slices, small_batches, text_bytes
from affinis.llm.tokens import tokenizer_path, word_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4064
    #: A gap below this is padded rather than filled with a cut.
    least_cut: int = 16
    #: A sequence with no more padding than this is not cut at powers of two.
    padding: int = 32


@dataclass
class Piece:
    """Ids [start, start + length) of a document; its first `lead` ids and its last one, the end mark, bear no loss."""

    doc: int
    doc_tokens: int
    start: int
    ids: bytes
    lead: int = 0

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def _loss_before(self, place: int) -> int:
        return max(min(place, self.doc_tokens - 1) - self.lead, 0)

    @property
    def loss(self) -> int:
        return self._loss_before(self.start + self.length) - self._loss_before(self.start)

    @property
    def free(self) -> int:
        """Ids from the piece's start on that bear no loss."""
        return min(max(self.lead - self.start, 0), self.length)

    def most(self, tokens: int, loss: int) -> int:
        """The longest head that has no more tokens and loss."""
        return min(tokens, self.length if self.loss <= loss else self.free + loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.doc_tokens, self.start, self.ids[: 4 * n], self.lead), Piece(self.doc, self.doc_tokens, self.start + n, self.ids[4 * n :], self.lead)


@dataclass
class Packer:
    """Gathers pieces and gives sequences back: lists of pieces within the limits."""

    limits: Limits
    window: int = 2048
    held: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        lim = self.limits
        while True:
            n = piece.most(lim.tokens, lim.loss)
            head, piece = (piece, None) if n == piece.length else piece.cut(n)
            if n == lim.tokens:
                yield [head]
            else:
                self.held.append(head)
            if piece is None:
                break
        while len(self.held) >= self.window:
            yield from self._pack(keep=self.window // 8)

    def rest(self) -> Iterator[list[Piece]]:
        yield from self._pack(keep=0)

    def _pack(self, keep: int) -> Iterator[list[Piece]]:
        """Packs all but about `keep` of the pieces held."""
        lim, pieces = self.limits, self.held
        n = len(pieces)
        if not n:
            return
        size, loss, free = (np.array([getattr(p, name) for p in pieces], np.int64) for name in ("length", "loss", "free"))
        need = np.stack([size / lim.tokens, np.full(n, 1 / lim.segments), loss / lim.loss], axis=1)
        alive = np.ones(n, bool)
        left_over = n
        while left_over > keep:
            tokens, segments, losses = lim.tokens, lim.segments, lim.loss
            sequence: list[Piece] = []
            while left_over and segments:
                fits = alive & (size <= tokens) & (loss <= losses)
                if not fits.any():
                    break
                room = np.array([tokens / lim.tokens, segments / lim.segments, losses / lim.loss])
                i = int(np.where(fits, need @ room, -1.0).argmax())
                sequence.append(pieces[i])
                tokens, segments, losses = tokens - int(size[i]), segments - 1, losses - int(loss[i])
                alive[i] = False
                left_over -= 1
            if left_over and segments and tokens >= lim.least_cut:
                heads = np.where(alive, np.minimum(np.where(loss <= losses, size, free + losses), tokens), 0)
                i = int(heads.argmax())
                if heads[i] >= lim.least_cut:
                    head, pieces[i] = pieces[i].cut(int(heads[i]))
                    sequence.append(head)
                    size[i], loss[i], free[i] = pieces[i].length, pieces[i].loss, pieces[i].free
                    need[i] = size[i] / lim.tokens, 1 / lim.segments, loss[i] / lim.loss
            yield from self._powers(sequence)
        self.held = [p for p, a in zip(pieces, alive, strict=True) if a]

    def _powers(self, sequence: list[Piece]) -> Iterator[list[Piece]]:
        """Cuts a sequence that would be padded into sequences of powers of two."""
        n = sum(p.length for p in sequence)
        while sequence:
            size = 1 << (n.bit_length() - 1)
            if self.limits.tokens - n <= self.limits.padding:
                size = n
            now, got = [], 0
            while got < size:
                piece = sequence.pop(0)
                if got + piece.length > size:
                    piece, tail = piece.cut(size - got)
                    sequence.insert(0, tail)
                now.append(piece)
                got += piece.length
            n -= size
            yield now


def _packed(path: str, end_id: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        encoder, packer = word_encoder(path), Packer(limits)
        end = int(end_id).to_bytes(4, "little")
        rows: list[tuple] = []

        def put(sequence: list[Piece]) -> None:
            nonlocal count
            at = 0
            for p in sequence:
                rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, base + count, at, p.loss))
                at += p.length
            count += 1

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            cols = np.array(rows, np.int64).reshape(-1, len(names)).T
            rows.clear()
            return pa.RecordBatch.from_arrays([ids_back(cols[0]), *map(pa.array, cols[1:])], names)

        for batch in batches:
            ids, share = ids_of(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            buf, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                tokens, at = encoder.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw = tokens.astype("<u4").tobytes()
                for k in range(lo, hi):
                    own = raw[4 * at[k - lo] : 4 * at[k - lo + 1]] + end
                    n = len(own) // 4
                    for sequence in packer.add(Piece(int(ids[k]), n, 0, own, n - 1 - round(share[k] * (n - 1)))):
                        put(sequence)
            if rows:
                yield out()
        for sequence in packer.rest():
            put(sequence)
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_share_col: str | None = None, tokenizer_name: str = "word_bpe_49k.json", end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document's ids are those of its text, then end_id, so a null or empty text has one.  Each id lies in one
    piece; the pieces of a sequence follow each other from offset 0 and keep within the limits.  loss_share_col
    has the share of a document's tokens that bear loss, its last ones but for the end mark: below 0 counts as 0, above
    1 as 1, null, NaN or no column as 1.  Documents of any length are cut to the limit.  Repeated rows, equal or null ids are packed each for itself.  An empty table gives no
    sequence.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    share = F.greatest(F.least(F.coalesce(F.nanvl(F.col(loss_share_col).cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(1.0)), F.lit(0.0)) if loss_share_col else F.lit(1.0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), share.alias("share"))
    out = rows.mapInArrow(lean(_packed(tokenizer_path(tokenizer_name), end_id, limits)), SCHEMA)
    return out.withColumnRenamed("doc_id", id_col)


def after_first_line(text: Column) -> Column:
    """The share of a text's bytes behind its first line, which stands for a prompt; 1 for a text of one line."""
    return F.when(F.instr(text, "\n") > 0, 1 - F.octet_length(F.substring_index(text, "\n", 1)) / F.octet_length(text)).otherwise(1.0)


def pack_documents(docs: DataFrame) -> DataFrame:
    """pack for a table of documents: their first lines bear no loss."""
    share = "loss_share"
    rows = docs.select("doc_id", "text", after_first_line(F.col("text")).alias(share))
    return pack(rows, loss_share_col=share)
