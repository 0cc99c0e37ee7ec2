"""Similarities of very many pairs of a few texts: what a text needs is laid out once, and steps move on the pairs of a chunk.

The results are those of ratios, token_set_ratios and partial_ratios of affinis.functions.similarity.  The partial ratio
needs two passes instead of one for each window: forwards a pass gives the common length of the shorter text with every
prefix of the longer one, backwards with every suffix.  Windows inside are aligned only where these bounds leave it open
whether they are better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from affinis.functions import similarity as sim

#: Pairs that are moved on together.
CHUNK = 1 << 13
#: Longer texts go through the functions of two lists.
LONGEST = 1 << 10
#: Numbers in the masks of all texts, at most; more pairs are split by their texts.
MOST_MASKS = 1 << 22
#: Windows of less than this share of the shorter text are looked at only where no longer one is better than any of them.
SMALL = 4

ONES = np.iinfo(np.uint64).max


@dataclass
class Compared:
    """By pair: ratio, token set ratio and partial ratio, and how many distinct words, and numbers, both texts have."""

    ratio: np.ndarray
    tset: np.ndarray
    partial: np.ndarray
    shared: np.ndarray
    numbers: np.ndarray


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Letters numbered from 1, the offsets between texts, and the number of letters and one."""
    raw, offsets = sim._codes(texts)
    some, at = np.unique(raw, return_inverse=True)
    return at + 1, offsets, len(some) + 1


def _table(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By place and text the letter; 0 behind a text's end."""
    size = np.diff(offsets)
    out = np.zeros((int(size.max(initial=0)), len(size)), np.int64)
    text = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(letters)) - offsets.take(text), text] = letters
    return out


def _masks(table: np.ndarray, many: int) -> np.ndarray:
    """By 64-bit word, and text times letters plus letter, the places where a text has a letter; none for letter 0."""
    n = table.shape[1]
    out = np.zeros((max(1, -(-len(table) // 64)), n * many), np.uint64)
    first = np.arange(n) * many
    for place, row in enumerate(table):
        out[place // 64, first + row] |= np.uint64(1) << np.uint64(place % 64)
    out[:, first] = 0
    return out


class _State:
    """Rows of the alignment tables of some pairs, one bit a letter of the pattern."""

    def __init__(self, words: int, n: int):
        self.now = np.full((words, n), ONES, np.uint64)
        self.room = [np.empty(n, np.uint64) for _ in range(3)]
        self.carry, self.over = np.zeros(n, np.uint64), np.empty(n, bool)

    def step(self, live: int, masks: list[np.ndarray]) -> None:
        total, rest, _ = (r[:live] for r in self.room)
        for w, m in enumerate(masks):
            now = self.now[w, :live]
            np.bitwise_and(now, m, out=total)
            np.bitwise_xor(now, total, out=rest)  # letters of now that the mask lacks
            total += now
            if len(self.now) > 1:
                over, carry = self.over[:live], self.carry[:live]
                if w:
                    np.less(total, now, out=over)
                    total += carry
                    if w + 1 < len(masks):
                        np.logical_or(over, total < carry, out=over)
                        carry[:] = over
                else:
                    np.less(total, now, out=over)
                    carry[:] = over
            np.bitwise_or(total, rest, out=now)

    def common(self, live: int) -> np.ndarray:
        out = np.bitwise_count(self.now[0, :live]).astype(np.int16)
        for row in self.now[1:]:
            out += np.bitwise_count(row[:live])
        return np.int16(64 * len(self.now)) - out


class Texts:
    """Distinct texts laid out for comparisons: letters and masks of either direction, and of the sorted distinct words."""

    def __init__(self, texts: list[str], numeric: set[str]):
        self.texts = texts
        letters, offsets, self.many = _letters(texts)
        self.size = np.diff(offsets)
        text = np.repeat(np.arange(len(texts)), self.size)
        back = offsets[:-1].take(text) + offsets[1:].take(text) - 1 - np.arange(len(letters))
        self.tables = _table(letters, offsets), _table(letters.take(back), offsets)
        self.masks = tuple(_masks(t, self.many) for t in self.tables)
        own = [sorted(set(t.split())) for t in texts]
        names = sorted(set().union(*own))
        number = {w: i for i, w in enumerate(names)}
        self.words = np.fromiter(map(len, own), np.int64, len(own))
        most = int(self.words.max(initial=0))
        self.ids = np.full((most, len(texts)), -1, np.int32)  # by place and text
        self.lengths = np.array([*map(len, names), 0], np.int64)
        self.numeric = np.array([*(w in numeric for w in names), False])
        known = dict(zip(np.concatenate([[0], letters]).tolist(), [0, *map(ord, "".join(texts))], strict=True))
        by_letter = {chr(c): k for k, c in known.items() if k}
        self.space = by_letter.get(" ", 0)
        self.spelt = _table(*self._spelt(names, by_letter))
        joined = [" ".join(o) for o in own]
        at = _table(*self._spelt(joined, by_letter))
        self.sorted_masks = _masks(at, self.many)
        self.sorted_size = np.fromiter(map(len, joined), np.int64, len(joined))
        self.spans = np.zeros((len(self.sorted_masks), most, len(texts)), np.uint64)
        for i, words in enumerate(own):
            start = 0
            for k, w in enumerate(words):
                self.ids[k, i] = number[w]
                size = len(w) + (k > 0)
                span = ((1 << size) - 1) << start
                for x in range(len(self.spans)):
                    self.spans[x, k, i] = span >> 64 * x & ONES
                start += size

    @staticmethod
    def _spelt(texts: list[str], by_letter: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter((by_letter[c] for t in texts for c in t), np.int64)
        return letters, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)

    def _pass(self, way: int, p: np.ndarray, t: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Common lengths of patterns with the first letters of texts, by how many; best takes what windows of those give."""
        masks, table = self.masks[way], self.tables[way]
        n, m, base = self.size.take(p), self.size.take(t), p * self.many
        words = -(-int(n.max()) // 64)
        steps, least, most = int(m[0]), int(n.min()) // SMALL, int(n.max())
        state, counts = _State(words, len(p)), np.zeros((steps + 1, len(p)), np.int16)
        live = len(p) - np.cumsum(np.bincount(m, minlength=steps + 1))  # pairs with more letters than so many
        index, value = np.empty(len(p), np.int64), np.empty(len(p))
        gathered = [np.empty(len(p), np.uint64) for _ in range(words)]
        for step in range(steps):
            k = int(live[step])
            table[step].take(t[:k], out=index[:k], mode="clip")
            index[:k] += base[:k]
            for w in range(words):
                masks[w].take(index[:k], out=gathered[w][:k], mode="clip")
            state.step(k, [g[:k] for g in gathered])
            if step < least:
                continue
            counts[step + 1, :k] = common = state.common(k)
            if step < most:
                v = np.multiply(common, 200.0, out=value[:k])
                v /= n[:k] + (step + 1)
                v *= n[:k] > step
                np.maximum(best[:k], v, out=best[:k])
        return counts

    def _inside(self, p: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Common lengths of patterns with as many letters of texts from start."""
        order = np.argsort(-self.size.take(p), kind="stable")
        p, t, start = p[order], t[order], start[order]
        n, masks, flat = self.size.take(p), self.masks[0], self.tables[0].ravel()
        words = -(-int(n[0]) // 64)
        state, base = _State(words, len(p)), p * self.many
        at = start * len(self.texts) + t
        live = len(p) - np.cumsum(np.bincount(n))
        for step in range(int(n[0])):
            k = int(live[step])
            index = flat.take(at[:k], mode="clip")
            index += base[:k]
            state.step(k, [masks[w].take(index, mode="clip") for w in range(words)])
            at[:k] += len(self.texts)
        out = np.empty(len(p), np.int64)
        out[order] = state.common(len(p))
        return out

    def aligned(self, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common lengths and partial ratios, with windows of t, which is not the shorter one; no text is empty."""
        order = np.argsort(-self.size.take(t), kind="stable")
        p, t = p[order], t[order]
        n, m, row = self.size.take(p), self.size.take(t), np.arange(len(p))
        best = np.zeros(len(p))
        ahead = self._pass(0, p, t, best)
        back = self._pass(1, p, t, best)
        common = ahead[m, row].astype(np.int64)
        open_ = np.flatnonzero((m - n > 1) & (200.0 * common / (n + n) > best))
        if len(open_):
            a, b, of, to, least = ahead.ravel(), back.ravel(), n.take(open_), m.take(open_), best.take(open_)
            which, starts, bounds = [], [], []
            for s in range(1, int((to - of).max())):
                k = np.flatnonzero(to - of > s)
                bound = np.minimum(a.take((s + of[k]) * len(p) + open_[k]), b.take((to[k] - s) * len(p) + open_[k]))
                k, bound = (x[200.0 * bound / (2 * of[k]) > least[k]] for x in (k, bound))
                which.append(open_[k])
                starts.append(np.full(len(k), s))
                bounds.append(bound)
            which, starts = np.concatenate(which), np.concatenate(starts)
            if len(which):
                found = self._inside(p[which], t[which], starts)
                np.maximum.at(best, which, 200.0 * found / (2 * n[which]))
        small = 200.0 / (SMALL + 1)
        rest = np.flatnonzero(best <= small)
        if len(rest):
            best[rest] = sim.partial_ratios([self.texts[i] for i in p[rest]], [self.texts[i] for i in t[rest]])
        lengths, partial = np.empty(len(p), np.int64), np.empty(len(p))
        lengths[order], partial[order] = common, best
        return lengths, partial

    def sets(self, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token set ratios, and how many distinct words and numbers are shared."""
        x, y = (self.ids[: int(self.words.take(i).max(initial=0))].take(i, axis=1) for i in (p, t))
        in_x, in_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        same = np.empty(len(p), bool)
        for k in range(len(x)):
            for j in range(len(y)):
                np.equal(x[k], y[j], out=same)
                in_x[k] |= same
                in_y[j] |= same
        in_x &= x >= 0
        in_y &= y >= 0
        shared, numbers = in_x.sum(axis=0), (self.numeric.take(x) & in_x).sum(axis=0)
        letters = (self.lengths.take(x) * in_x).sum(axis=0)
        n = letters + np.maximum(shared - 1, 0)
        left, right = (self.words.take(i) - shared for i in (p, t))

        def rest(i: np.ndarray, own: np.ndarray) -> np.ndarray:
            every = self.sorted_size.take(i) - np.maximum(self.words.take(i) - 1, 0)
            return every - letters + np.maximum(own - 1, 0)

        out = np.zeros(len(p))
        some = (self.words.take(p) > 0) & (self.words.take(t) > 0)
        whole = some & (shared > 0) & ((left == 0) | (right == 0))
        out[whole] = 100.0
        todo = np.flatnonzero(some & ~whole)
        if len(todo):
            common = self._rests(p[todo], t[todo], (x[:, todo] >= 0) & ~in_x[:, todo], y[:, todo], (y[:, todo] >= 0) & ~in_y[:, todo])
            n_, left_, right_ = n[todo], rest(p, left)[todo], rest(t, right)[todo]
            lead = n_ + (n_ > 0)
            full_left, full_right = lead + left_, lead + right_
            best = 200.0 * (lead + common) / (full_left + full_right)
            alone = np.maximum(200.0 * n_ / (n_ + full_left), 200.0 * n_ / (n_ + full_right))
            out[todo] = np.where(n_ > 0, np.maximum(best, alone), best)
        return out, shared, numbers

    def _rests(self, p: np.ndarray, t: np.ndarray, own: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common lengths of the words of p in own with those of t, the words y, in other; each in order, a space between."""
        words = max(1, -(-int(self.sorted_size.take(p).max()) // 64))
        keep = np.zeros((words, len(p)), np.uint64)
        for w in range(words):
            for k in range(len(own)):
                keep[w] |= self.spans[w, k].take(p) * own[k]
        lead = ~own[0]  # the space before the first word goes
        for w in range(words):
            lowest = keep[w] & (~keep[w] + np.uint64(1))
            keep[w] ^= np.where(lead, lowest, np.uint64(0))
            lead = lead & (lowest == 0)
        begun = np.zeros(len(p), bool)
        out = _State(words, len(p))
        base = p * self.many
        for k in range(len(y)):
            sub = np.flatnonzero(other[k])
            if not len(sub):
                continue
            size = self.lengths.take(y[k].take(sub))
            sub = sub[np.argsort(-size, kind="stable")]
            word, first = y[k].take(sub), ~begun.take(sub)
            size, at, mine = self.lengths.take(word), base.take(sub), keep[:, sub]
            state = _State(words, len(sub))
            state.now = out.now[:, sub]
            live = len(sub) - np.cumsum(np.bincount(size))
            for step in range(-1, int(size[0])):
                n = len(sub) if step < 0 else int(live[step])
                index = at + self.space if step < 0 else at[:n] + self.spelt[step].take(word[:n])
                masks = [self.sorted_masks[w].take(index, mode="clip") for w in range(words)]
                for w, m in enumerate(masks):
                    m &= mine[w, :n]
                    if step < 0:
                        m[first] = 0
                state.step(n, masks)
            out.now[:, sub] = state.now
            begun[sub] = True
        return out.common(len(p)).astype(np.int64)


def compare(texts: list[str], left: np.ndarray, right: np.ndarray, numeric: set[str] = frozenset()) -> Iterator[tuple[slice, Compared]]:
    """Chunk by chunk the similarities of texts left[i] and right[i]; numeric: the words that are numbers."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words = -(-np.minimum(size, LONGEST).max(initial=1) // 64)
    fit = Texts([t if len(t) <= LONGEST else "" for t in texts], numeric) if len(texts) * words * len(set().union(*texts)) <= MOST_MASKS else None
    for lo in range(0, len(left), CHUNK):
        a, b = left[lo : lo + CHUNK], right[lo : lo + CHUNK]
        own = fit
        if own is None:
            some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            mine = [texts[i] for i in some]
            if len(mine) < len(texts):
                parts = [c for _, c in compare(mine, at[: len(a)], at[len(a) :], numeric)]
            elif len(a) > 1:
                half = len(a) // 2
                parts = [c for q in (slice(0, half), slice(half, None)) for _, c in compare([*mine, ""], a[q], b[q], numeric)]
            else:
                parts = [_plain(mine, a, b, numeric)]
            yield slice(lo, lo + len(a)), Compared(*(np.concatenate([getattr(c, f) for c in parts]) for f in Compared.__dataclass_fields__))
            continue
        n, m = size.take(a), size.take(b)
        ratio, partial = np.where(n + m > 0, 0.0, 100.0), np.where(n + m > 0, 0.0, 100.0)
        p, t = np.where(n <= m, a, b), np.where(n <= m, b, a)
        some = np.flatnonzero((n > 0) & (m > 0) & (np.maximum(n, m) <= LONGEST))
        if len(some):
            common, best = own.aligned(p[some], t[some])
            even = np.flatnonzero((n[some] == m[some]) & (p[some] != t[some]))
            if len(even):  # windows of either one
                best[even] = np.maximum(best[even], own.aligned(t[some[even]], p[some[even]])[1])
            ratio[some], partial[some] = 200.0 * common / (n + m)[some], best
        tset, shared, numbers = own.sets(p, t)
        out = Compared(ratio, tset, partial, shared, numbers)
        long = np.flatnonzero(np.maximum(n, m) > LONGEST)
        if len(long):
            rest = _plain(texts, a[long], b[long], numeric)
            for f in Compared.__dataclass_fields__:
                getattr(out, f)[long] = getattr(rest, f)
        yield slice(lo, lo + len(a)), out


def _plain(texts: list[str], left: np.ndarray, right: np.ndarray, numeric: set[str]) -> Compared:
    """The same by the functions of two lists."""
    a, b = [texts[i] for i in left], [texts[i] for i in right]
    both = [set(x.split()) & set(y.split()) for x, y in zip(a, b, strict=True)]
    counts = (np.array([len(x) for x in s], np.int64) for s in (both, [x & numeric for x in both]))
    return Compared(sim.ratios(a, b), sim.token_set_ratios(a, b), sim.partial_ratios(a, b), *counts)
