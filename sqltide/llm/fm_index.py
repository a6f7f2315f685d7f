"""A bidirectional FM-index over delimited words, and search schemes with one error.

The text is all words, each between delimiters.  Two suffix orders, of the text and of the text
reversed, give a pattern's interval of suffix ranks in both at once; either end of a pattern
can be extended by a letter, and both intervals follow from counts of letters in front of a rank.
Counts stand in a table of every 16th rank, the rest is counted in the text.  All queries move
one step at a time, side by side.
"""

from __future__ import annotations

import numpy as np

STEP = 16
CHUNK = 4096


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Places of the suffixes by their first ``longest`` letters and more, by doubling."""
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < longest and rank.max() + 1 < len(text):
        pair = rank * (len(text) + 1) + np.roll(rank, -width)
        rank, width = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * width
    return np.argsort(rank, kind="stable")


class Side:
    """Letters in front of the suffixes in their order: extends a pattern to one side."""

    def __init__(self, text: np.ndarray, letters: int, longest: int):
        self.order = suffix_order(text, longest)
        before = text[self.order - 1]
        n, self.letters = len(text), letters
        blocks = n // STEP + 1
        self.before = np.append(before, np.zeros(blocks * STEP - n, text.dtype)).reshape(blocks, STEP)
        cell = (np.arange(n) // STEP) * letters + before
        counts = np.bincount(cell, minlength=blocks * letters).reshape(blocks, letters)
        upto = np.cumsum(counts, axis=0) - counts
        #: less[b, c]: letters under c in front of the first b * STEP suffixes
        self.less = np.zeros((blocks, letters + 1), dtype=np.int32)
        np.cumsum(upto, axis=1, out=self.less[:, 1:])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])

    def under(self, c: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Letters under ``c`` in front of the suffixes below ``rank``."""
        block, rest = rank // STEP, rank % STEP
        part = (self.before[block] < c[:, None]) & (np.arange(STEP) < rest[:, None])
        return self.less[block, c] + part.sum(axis=1)

    def under_all(self, rank: np.ndarray) -> np.ndarray:
        """The same for every letter, a row for each rank."""
        block, rest = rank // STEP, rank % STEP
        row, at = np.nonzero(np.arange(STEP) < rest[:, None])
        part = np.bincount(row * self.letters + self.before[block[row], at],
                           minlength=len(rank) * self.letters).reshape(len(rank), self.letters)
        out = self.less[block].astype(np.int64)
        out[:, 1:] += np.cumsum(part, axis=1)
        return out

    def extend(self, low, other, size, c):
        """A pattern's intervals after one more letter on this side."""
        high = low + size
        a, b = self.under(c, low), self.under(c, high)
        a1, b1 = self.under(c + 1, low), self.under(c + 1, high)
        return self.first[c] + a1 - a, other + b - a, (b1 - b) - (a1 - a)

    def extend_all(self, low, other, size):
        """All letters but the delimiter that can follow: the pattern's place among those given,
        the letter, and the intervals."""
        a, b = self.under_all(low), self.under_all(low + size)
        here, there = np.diff(a, axis=1), np.diff(b, axis=1)
        row, c = np.nonzero((there - here)[:, 1:])
        c = c + 1
        return row, c, self.first[c] + here[row, c], other[row] + (b - a)[row, c], \
            (there - here)[row, c]


class BidirectionalIndex:
    """Over distinct words, as arrays of letters from 1 on; 0 delimits."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, alphabet: int):
        self.sizes = sizes
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.text = np.zeros(int(sizes.sum() + len(sizes)) + 1, dtype=np.int64)
        inside = np.ones(len(self.text), dtype=bool)
        inside[self.begin] = inside[-1] = False
        self.text[inside] = letters
        longest = int(sizes.max(initial=0)) + 3
        self.left = Side(self.text, alphabet, longest)
        self.right = Side(self.text[::-1].copy(), alphabet, longest)

    def one_error(self, asked: np.ndarray, by_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, word) pairs of words that differ by one letter from words asked.

        ``by_left``: the left half is matched exactly and the error lies right of it; else the
        right half is, and the error lies left of it, in words with another left half.
        """
        pairs = [self._searched(asked[k:k + CHUNK], by_left) for k in range(0, len(asked), CHUNK)]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return (np.concatenate([q + k * CHUNK for k, (q, _) in enumerate(pairs)]),
                np.concatenate([w for _, w in pairs]))

    def _searched(self, asked, by_left):
        half = self.sizes[asked] // 2
        exact, rest = (half, self.sizes[asked] - half) if by_left \
            else (self.sizes[asked] - half, half)
        middle = self.begin[asked] + 1 + half
        # The exact half grows outwards from the middle, then the other half does.
        inner, outer = (self.left, self.right) if by_left else (self.right, self.left)
        first, second = (middle - 1, middle) if by_left else (middle, middle - 1)
        step = -1 if by_left else 1

        live = np.arange(len(asked))
        low = np.zeros(len(asked), np.int64)
        other, size = low.copy(), np.full(len(asked), len(self.text))
        for t in range(int(exact.max(initial=0)) + 1):
            on = live[(t <= exact[live]) & (size[live] > 0)]
            # Behind its last letter each half has its delimiter.
            low[on], other[on], size[on] = inner.extend(
                low[on], other[on], size[on], self.text[first[on] + step * t])
        live = live[size > 0]
        return self._extended(asked, live, other[live], low[live], size[live], second, -step, rest,
                              outer, half, by_left)

    def _extended(self, asked, q, low, other, size, second, step, rest, side, half, by_left):
        at, wrong = np.zeros(len(q), np.int64), np.zeros(len(q), dtype=bool)
        found = []
        while len(q):
            over = at == rest[q]
            nexts = self.text[second[q] + step * at]
            # States with their error behind them, and exact ones, go on by the next letter; at
            # the end that is the delimiter.
            on = np.flatnonzero(wrong | ~over)
            l1, o1, s1 = side.extend(low[on], other[on], size[on], nexts[on])
            ok = s1 > 0
            on, l1, o1, s1 = on[ok], l1[ok], o1[ok], s1[ok]
            end = over[on]
            found.append((q[on[end]], l1[end], o1[end]))
            more = [(q[on[~end]], l1[~end], o1[~end], s1[~end], at[on[~end]] + 1, wrong[on[~end]])]
            right = np.flatnonzero(~wrong)
            if len(right):
                row, c, l2, o2, s2 = side.extend_all(low[right], other[right], size[right])
                of = right[row]
                yes = np.ones(len(of), dtype=bool)
                more.append((q[of], l2, o2, s2, at[of], yes))  # a letter more
                put = ~over[of] & (c != nexts[of])
                more.append((q[of[put]], l2[put], o2[put], s2[put], at[of[put]] + 1, yes[put]))
                left = right[~over[right]]
                more.append((q[left], low[left], other[left], size[left], at[left] + 1,
                             np.ones(len(left), dtype=bool)))  # a letter less
            q, low, other, size, at, wrong = (np.concatenate(v) for v in zip(*more, strict=True))
        which, low, other = (np.concatenate(v) for v in zip(*found, strict=True)) if found \
            else (np.zeros(0, np.int64),) * 3
        rank = other if by_left else low  # among the suffixes of the text as it stands
        word = np.searchsorted(self.begin, self.left.order[rank])
        pairs = np.unique(which * len(self.sizes) + word)
        which, word = pairs // len(self.sizes), pairs % len(self.sizes)
        if not by_left and len(which):
            same = np.ones(len(which), dtype=bool)
            for t in range(int(half[which].max())):
                inside = t < half[which]
                same &= ~inside | (self.text[self.begin[asked[which]] + 1 + np.where(inside, t, 0)]
                                   == self.text[self.begin[word] + 1 + np.where(inside, t, 0)])
            which, word = which[~same], word[~same]
        return which, word
