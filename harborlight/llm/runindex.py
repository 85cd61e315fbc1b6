"""A run-length index (r-index) of a set of strings, with matching statistics.

The Burrows-Wheeler transform of the joined strings is kept as runs: head byte, first row, and
the text positions sampled at both ends of every run. Patterns are streamed from right to left,
all in lockstep: a byte that equals the current run's head moves by the LF mapping, any other
byte repositions at the end of the run of that byte above or the start of the one below,
whichever matches longer. Beside the runs the index keeps the bytes themselves, one a symbol,
which tell how long the match is at a sampled position. That gives, for every pattern position, the length of the longest
match and a row it ends in.

Rows whose suffixes share their first `depth` bytes form a class. The index keeps the first row
of each class and the least order key of its occurrences, so a match of `depth` bytes or more
names the earliest equal string at once.
"""

from __future__ import annotations

import numpy as np


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to 256 for bytes and 0 behind every string, and where each string starts."""
    size = np.array([len(s) for s in strings], np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int(size.sum()) + len(strings), np.uint16)
    here = np.ones(len(text), bool)
    here[start + size] = False
    text[here] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return text, start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols below 512 by prefix doubling; only tied suffixes are sorted again."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        if k < n:
            key[: n - k] |= text[k:].astype(np.int64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.append(True, sorted_key[1:] != sorted_key[:-1]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 7
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        key = (rank[at] << 32) + rank[np.minimum(at + step, n)] + 1
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[tied] = at
        fresh = np.append(True, key[1:] != key[:-1])
        first[tied] = fresh
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        step *= 2


def packed_words(text: np.ndarray) -> np.ndarray:
    """Seven symbols from each position in one word, zero behind the end."""
    out = np.zeros(len(text) + 512, np.int64)
    for k in range(7):
        out <<= 9
        if k < len(text):
            out[: len(text) - k] |= text[k:].astype(np.int64)
    return out


def byte_words(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each position as one word, without a copy for each; all have to be
    below 256, which the bytes of UTF-8 are (0xF8 and more do not occur in it)."""
    if len(text) and int(text.max()) > 255:
        raise ValueError("not UTF-8")
    raw = np.zeros(len(text) + 520, np.uint8)
    raw[: len(text)] = text
    return np.ndarray((len(text) + 512,), "<u8", raw, strides=(1,))


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, counted up to `most`."""
    out = np.minimum(most, 0)
    live = np.flatnonzero(most > 0)
    one = np.uint64(1)
    while len(live):
        x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        # zero bits below the lowest set one, all 64 if there is none
        equal = (np.bitwise_count(~x & (x - one)) >> 3).astype(np.int64)
        out[live] += equal
        live = live[(equal == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


class RunIndex:
    def __init__(self, strings: list[bytes], keys: np.ndarray, depth: int):
        """keys: order key of each string's first byte; later bytes have the next numbers."""
        text, start = joined(strings)
        n, self.depth = len(text), depth
        rows = suffix_array(text)
        self.words = byte_words(text)
        bwt = text[rows - 1]
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.first = head
        self.last = np.append(head[1:], n) - 1
        self.head = bwt[head].astype(np.int64)
        self.first_at, self.last_at = rows[self.first], rows[self.last]
        size = self.last - self.first + 1
        # runs by byte: where each byte's runs are listed, and how often it occurs before each run
        self.by_byte = np.lexsort((np.arange(len(head)), self.head))
        self.byte_runs = np.searchsorted(self.head[self.by_byte], np.arange(258))
        before = np.cumsum(size[self.by_byte]) - size[self.by_byte]  # counts rows of smaller bytes, too: LF at once
        self.lf = np.empty(len(head), np.int64)
        self.lf[self.by_byte] = before
        # classes of rows that share `depth` bytes
        owner = np.repeat(np.arange(len(strings)), np.diff(np.append(start, n)))
        offset = np.arange(n) - start[owner]
        long = np.array([len(s) for s in strings], np.int64)[owner] - offset >= depth
        same = np.zeros(n, bool)
        both = np.flatnonzero(long[rows[1:]] & long[rows[:-1]]) + 1
        same[both] = common_prefix(self.words, rows[both], rows[both - 1], np.full(len(both), depth)) == depth
        self.class_at = np.flatnonzero(~same)
        order = keys[owner] + offset
        self.earliest = np.minimum.reduceat(order[rows], self.class_at)
        self.runs, self.rows = len(head), n
        self.codes = self.head[self.by_byte] * (self.runs + 1) + self.by_byte

    def stream(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, offset, earliest key) of every position that matches `depth` bytes or more."""
        size = np.array([len(p) for p in patterns], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        most = int(size[0]) if len(size) else 0
        grid = np.zeros((most, len(size)), np.int16)  # a row a step from the right end
        for column, i in enumerate(order):
            grid[: size[column], column] = np.frombuffer(patterns[i], np.uint8)[::-1]
        row = np.zeros(len(size), np.int64)
        at, length = self.first_at[np.zeros(len(size), np.int64)].copy(), np.zeros(len(size), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(most):
            live = int(np.searchsorted(-size, -step, side="left"))
            symbol = grid[step, :live].astype(np.int64) + 1
            r, p, m = row[:live], at[:live], length[:live]
            run = np.searchsorted(self.first, r, side="right") - 1
            miss = np.flatnonzero(self.head[run] != symbol)
            if len(miss):
                self.reposition(miss, symbol, run, r, p, m)
            known = m >= 0
            r[:] = np.where(known, self.lf[run] + r - self.first[run], 0)
            p[:] = np.where(known, p - 1, self.first_at[0])
            m[:] = np.where(known, m + 1, 0)
            hit = np.flatnonzero(m >= self.depth)
            if len(hit):
                group = np.searchsorted(self.class_at, r[hit], side="right") - 1
                found.append((order[hit], size[hit] - step - 1, self.earliest[group]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def reposition(self, miss, symbol, run, row, at, length) -> None:
        """Move the states in `miss` to the better neighbouring run of their byte, in place.

        A byte that the text lacks leaves length -1: the match starts anew behind it.
        """
        s = symbol[miss]
        low, high = self.byte_runs[s], self.byte_runs[s + 1]
        nth = low + self.rank_among(s, run[miss])
        up, down = nth - 1, nth
        has_up, has_down = up >= low, down < high
        up, down = self.by_byte[np.where(has_up, up, 0)], self.by_byte[np.where(has_down, down, 0)]
        la = common_prefix(self.words, at[miss], self.last_at[up], np.where(has_up, length[miss], 0))
        lb = common_prefix(self.words, at[miss], self.first_at[down], np.where(has_down, length[miss], 0))
        use_up = has_up & (~has_down | (la >= lb))
        none = ~has_up & ~has_down
        run[miss] = np.where(use_up, up, np.where(none, 0, down))
        row[miss] = np.where(use_up, self.last[up], np.where(none, 0, self.first[down]))
        at[miss] = np.where(use_up, self.last_at[up], np.where(none, 0, self.first_at[down]))
        length[miss] = np.where(none, -1, np.where(use_up, la, lb))

    def rank_among(self, symbol: np.ndarray, run: np.ndarray) -> np.ndarray:
        """How many runs of `symbol` stand before `run`."""
        return np.searchsorted(self.codes, symbol * (self.runs + 1) + run) - self.byte_runs[symbol]
