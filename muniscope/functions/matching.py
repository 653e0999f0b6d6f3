"""Ratcliff-Obershelp ratios of many pairs of texts at once, in numpy inside a task."""

from __future__ import annotations

import numpy as np

#: Cells of the rows of match tables that are held at once; a pair whose row is wider goes alone.
CELLS = 1 << 17
#: Letters are counted in so many classes at most.
CLASSES = 64


class Texts:
    """Distinct texts as numbered characters, one after the other."""

    def __init__(self, texts: list[str]):
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        seen = np.zeros(int(chars.max(initial=0)) + 1, dtype=bool)
        seen[chars] = True
        letters = int(seen.sum())
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32) if letters + 2 <= np.iinfo(k).max)
        # Two values that no character has end the list; what is beyond a text's end equals nothing.
        number = (np.cumsum(seen) - 1).astype(self.kind)
        self.chars = np.append(number[chars], [letters, letters + 1]).astype(self.kind)
        self.classes = max(1, min(CLASSES, letters))
        owner = np.repeat(np.arange(len(texts)), self.size)
        counts = np.bincount(owner * self.classes + self.chars[:-2] % self.classes, minlength=len(texts) * self.classes)
        most = int(self.size.max(initial=0))
        self.counts = np.ascontiguousarray(counts.reshape(len(texts), self.classes).T.astype(np.uint8 if most < 256 else np.int32))

    def most_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most so many characters can be matched: what the two have in common of each class of letters."""
        out = np.zeros(len(i), dtype=np.int32)
        for row in self.counts:
            out += np.minimum(row.take(i), row.take(j))
        return out


def _longest(t: Texts, at: np.ndarray, n: np.ndarray, to: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in a, start in b) of the longest common block of a range of n characters from ``at`` and one of m from ``to``.

    Of equal lengths the first in a, of these the first in b, as difflib has it. Only two rows of the table are held."""
    high, wide = int(n.max()), int(m.max())
    end = len(t.chars)
    a, b = np.arange(high)[:, None], np.arange(wide)[:, None]
    a = t.chars[np.where(a < n, at + a, end - 2)]
    b = t.chars[np.where(b < m, to + b, end - 1)]
    kind = np.uint8 if min(high, wide) < 255 else np.uint32
    before, cell = np.zeros((wide + 1, len(n)), dtype=kind), np.zeros((wide + 1, len(n)), dtype=kind)
    same = np.empty(b.shape, dtype=bool)
    best, row, column = np.zeros(len(n), dtype=kind), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    grew = np.zeros(len(n), dtype=bool)

    def settle(which: np.ndarray, i: int, cells: np.ndarray) -> None:  # a block that has stopped growing is looked up in its last row
        row[which] = i
        column[which] = cells[1:, which].argmax(axis=0)

    for i in range(high):
        now = cell[1:]
        np.equal(b, a[i], out=same)
        np.add(before[:-1], kind(1), out=now)
        np.multiply(now, same.view(np.uint8), out=now)
        top = now.max(axis=0)
        grows = top > best
        done = np.flatnonzero(grew & ~grows)
        if len(done):
            settle(done, i - 1, before)
        np.maximum(best, top, out=best)
        before, cell, grew = cell, before, grows
    settle(np.flatnonzero(grew), high - 1, before)
    length = best.astype(np.int64)
    return length, row - length + 1, column - length + 1


def ratios(t: Texts, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """The ratio of texts i and j, i first: the measure is not symmetric. Where it cannot exceed the threshold, 0 or the ratio.

    All pairs go one level down together: each finds its longest block, and what is left and right of it are the next ranges."""
    total = t.size[i] + t.size[j]
    matched = np.zeros(len(i), dtype=np.int64)
    live = np.ones(len(i), dtype=bool)
    pair, at, n, to, m = np.arange(len(i)), t.start[i], t.size[i], t.start[j], t.size[j]
    while len(pair):
        order = np.lexsort((np.minimum(n, m), np.maximum(n, m)))
        pair, at, n, to, m = (x[order] for x in (pair, at, n, to, m))
        longer = np.maximum(n, m)
        size, x, y = (np.zeros(len(pair), dtype=np.int64) for _ in range(3))
        low = 0
        while low < len(pair):
            # Ranges of about one size go together, as many as the cells allow.
            high = min(len(pair), low + max(1, CELLS // int(longer[low])))
            high = low + max(1, min(high - low, CELLS // int(longer[high - 1])))
            part = slice(low, high)
            size[part], x[part], y[part] = _longest(t, at[part], n[part], to[part], m[part])
            low = high
        matched += np.bincount(pair, weights=size, minlength=len(i)).astype(np.int64)
        hit = size > 0
        pair, at, n, to, m, size, x, y = (v[hit] for v in (pair, at, n, to, m, size, x, y))
        pair = np.concatenate([pair, pair])
        at, to = np.concatenate([at, at + x + size]), np.concatenate([to, to + y + size])
        n, m = np.concatenate([x, n - x - size]), np.concatenate([y, m - y - size])
        some = (n > 0) & (m > 0)
        pair, at, n, to, m = (v[some] for v in (pair, at, n, to, m))
        left = np.bincount(pair, weights=np.minimum(n, m), minlength=len(i)).astype(np.int64)
        live &= 2.0 * (matched + left) / total > threshold
        keep = live[pair]
        pair, at, n, to, m = (v[keep] for v in (pair, at, n, to, m))
    return np.where(live, 2.0 * matched / total, 0.0)


def near(t: Texts, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, ratios): of the pairs those with a ratio above the threshold. Bounds by lengths and letters come first; equal pairs
    are scored once. The bounds divide as the ratio does, so that rounding cannot part them."""
    total = t.size[i] + t.size[j]
    place = np.flatnonzero(2.0 * np.minimum(t.size[i], t.size[j]) / total > threshold)
    place = place[2.0 * t.most_common(i[place], j[place]) / total[place] > threshold]
    once, back = np.unique(i[place] * len(t.size) + j[place], return_inverse=True)
    score = ratios(t, once // len(t.size), once % len(t.size), threshold)[back]
    over = score > threshold
    return place[over], score[over]
