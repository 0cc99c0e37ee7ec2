"""Public tokenizers on the executors."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np

from affinis.llm.common import prefix_sums, range_hashes, words_of


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """One per Python worker; tasks are parallel already, so the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo:
    """What was computed for a part of text.  Bounded: of two generations the older goes when the newer is full.

    A part that is found in the older one moves to the newer, so common parts stay.
    """

    LONGEST, MOST = 48, 350_000

    def __init__(self):
        self.new, self.old = {}, {}

    def missing(self, parts: set[str]) -> list[str]:
        """The parts that are not known; those known move to the newer generation."""
        out = []
        new, old = self.new, self.old
        for p in parts - new.keys():
            if p in old:
                new[p] = old[p]
            else:
                out.append(p)
        return out

    def trim(self, long: list[str]) -> None:
        for p in long:
            self.new.pop(p, None)
        if len(self.new) > self.MOST:
            self.new, self.old = {}, self.new


def _stem(part: str) -> tuple[str, str]:
    """A part as (stem, mark) if it is a plain word, maybe with a full stop or comma behind it, else ("", "").

    Letters below U+0130 have one lower-case letter each, and the tokenizer's pieces of letters end before a mark.
    """
    if part.isalpha():
        stem, mark = part, ""
    elif part[-1:] in (".", ",") and part[:-1].isalpha():
        stem, mark = part[:-1], part[-1]
    else:
        return "", ""
    return (stem.lower(), mark) if stem.isascii() or max(stem) < "\u0130" else ("", "")


class WordEncoder:
    """Token ids of whole texts by a tokenizer of lower-case words that drops white space, with a bounded memo.

    The tokenizer's pieces never span white space, and its normaliser treats what lies between alone, so a text's ids
    are those of its words in order.  Words are told apart by 64-bit hashes, and each new one is encoded by the library:
    plain words many at a time, once for all their capitals and marks, cut by the tokens that end a word; all else one
    by one.  A worker keeps its memo, sorted arrays of hashes and ids, over tasks.
    """

    TOGETHER, MOST = 256, 1_000_000

    def __init__(self, path: str):
        self.path = path
        self.ends: np.ndarray | None = None
        self.known, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of plain lower-case words; each is one piece, so its last token and no other ends a word."""
        t = tokenizer(self.path)
        if self.ends is None:
            vocabulary = t.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        groups = [words[k : k + self.TOGETHER] for k in range(0, len(words), self.TOGETHER)]
        for group, e in zip(groups, t.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), 0
            cuts = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            for word, cut in zip(group, cuts, strict=True):
                yield word, raw[at:cut]
                at = cut

    def _learn(self, words: list[str]) -> list[bytes]:
        stems = [_stem(w) for w in words]
        found = dict(self._words(list({s for s, _ in stems if s})))
        others = list({w for w, (s, _) in zip(words, stems, strict=True) if not s} | {m for _, m in stems if m})
        if others:
            encoded = tokenizer(self.path).encode_batch_fast(others, add_special_tokens=False)
            found |= {p: array("I", e.ids).tobytes() for p, e in zip(others, encoded, strict=True)}
        return [(found[s] + found[m] if m else found[s]) if s else found[w] for w, (s, m) in zip(words, stems, strict=True)]

    def _places(self, hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the sorted, distinct words are in the memo, new ones learned first."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if not len(new):
            return at
        if len(self.known) + len(new) > self.MOST:  # start again with the words in use
            self.known, self.start, self.size, self.ids = self.known[:0], self.start[:0], self.size[:0], self.ids[:0]
            new = np.arange(len(hashes))
        raw = buf.tobytes()
        learned = self._learn([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        size = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
        known = np.concatenate([self.known, hashes[new]])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learned), "<u4")])
        return np.searchsorted(self.known, hashes)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8 bytes, and the offsets between rows."""
        start, end, at = words_of(buf, offsets)
        hashes, first, where = np.unique(range_hashes(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
        place = self._places(hashes, buf, start[first], end[first])
        size, source = self.size[place][where], self.start[place][where]
        cuts = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(source - cuts[:-1], size) + np.arange(cuts[-1])]
        return ids, cuts[at]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class PieceCounter:
    """Token counts of whole texts by a byte-level tokenizer, with a bounded memo.

    Where a blank follows a character that is no white space a piece always starts, whatever is around it (see
    token_count).  Texts in which every blank is such a place are counted part by part, each part with its blank
    encoded by the library once; other texts are encoded as a whole.
    """

    UNSTABLE = re.compile(r"(?:^|\s) ")

    def __init__(self, path: str):
        self.path, self.memo = path, Memo()

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: Sequence[str]) -> list[int]:
        out, parts = [0] * len(texts), {}
        whole = []
        for k, t in enumerate(texts):
            if self.UNSTABLE.search(t):
                whole.append(k)
            else:
                first, *rest = t.split(" ")
                whole.append(k) if not first else parts.update({k: rest})
        firsts = {k: texts[k].split(" ", 1)[0] for k in parts}
        todo = [texts[k] for k in whole] + list(firsts.values())
        if todo:
            counts = self._encoded(todo)
            for k, n in zip([*whole, *firsts], counts, strict=True):
                out[k] = n
        new = self.memo.missing(set().union(*parts.values()))
        known = self.memo.new
        if new:
            known.update(zip(new, self._encoded([" " + p for p in new]), strict=True))
        for k, rest in parts.items():
            out[k] += sum(map(known.__getitem__, rest))
        self.memo.trim([p for p in new if len(p) > Memo.LONGEST])
        return out


@functools.cache
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
