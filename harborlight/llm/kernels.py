"""Vectorised byte kernels shared by the corpus operators.

All of them take the concatenated UTF-8 bytes of one Arrow batch plus row offsets, so the cost
of a batch is a fixed number of numpy passes and not a Python loop over words. None keeps state
between batches. Hashes are 64-bit and fixed: they depend on the bytes alone, never on the
process, so a task that is run again on another executor gives the same values.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random-looking word per byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of every run of bytes outside space and 9-13, A-Z lower-cased first.

    The hash is a polynomial: good for counts and statistics, where strings made to clash do no
    harm. Whatever must not clash uses `interned`.
    """
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    rows_at = off[:-1][off[:-1] < len(raw)]
    before[rows_at] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends_at = off[1:][off[1:] > 0] - 1
    after[ends_at] = False
    end = np.flatnonzero(solid & ~after) + 1
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_CODE[LOWER[raw]] * powers(_BASE, len(raw)), out=sums[1:])
    back = powers(_INVERSE, int(start[-1]) + 1)[start] if len(start) else np.zeros(0, U64)
    code = (sums[end] - sums[start]) * back
    row = np.searchsorted(off, start, side="right") - 1
    return mix(code + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), row, start


#: Bytes of search terms: ASCII letters and digits, and all of every other character.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def interned(raw: np.ndarray, off: np.ndarray, solid: np.ndarray = ~IS_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(id, row, length, dictionary) of every run of solid bytes, in order; runs end with their row.

    Ids are places in the dictionary of the batch's distinct runs, so equal ids are equal bytes
    and nothing rests on a hash. lower: A-Z count as a-z.
    """
    inside = solid[raw]
    n = len(raw)
    before = np.append(False, inside[:-1])[:n]
    before[off[:-1][off[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False)[:n]
    after[off[1:][off[1:] > 0] - 1] = False
    length = np.flatnonzero(inside & ~after) + 1 - start
    held = raw[inside]
    edge = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=edge[1:])
    buffers = [None, pa.py_buffer(edge), pa.py_buffer(LOWER[held] if lower else held)]
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode()
    row = np.searchsorted(off, start, side="right") - 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, length, coded.dictionary


def lanes(dictionary: pa.Array) -> np.ndarray:
    """Two 64-bit words per distinct word: its BLAKE2b digest, so no two words are made to share one."""
    found = b"".join([blake2b(w, digest_size=16).digest() for w in dictionary.to_pylist()])
    return np.frombuffer(found, "<u8").reshape(-1, 2).astype(U64)


def chained(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a word sequence with one more word."""
    return mix(value * U64(0x2545F4914F6CDD1D) + word)


def shingle_lanes(raw: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, row offsets) of the distinct word shingles of every row, sorted by first.

    A shingle is 128 bits, `first` and `second`, made from 128 bits of each word. A row with 1
    to width - 1 words has its whole sequence as its only shingle; a row without words has none.
    """
    rows = len(off) - 1
    code, row, _, dictionary = interned(raw, off)
    word = lanes(dictionary)[code] if len(code) else np.zeros((0, 2), U64)
    count = np.bincount(row, minlength=rows)
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    full = max(0, len(code) - width + 1)
    value = np.zeros((full, 2), U64)
    for k in range(width):
        value = chained(value, word[k : k + full])
    place = np.maximum(count - width + 1, 0)
    edge = np.zeros(rows + 1, np.int64)
    first, second = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for r in range(rows):
        if place[r]:
            own = value[begin[r] : begin[r] + place[r]]
        elif count[r]:
            own = np.full((1, 2), count[r], U64)
            for k in range(begin[r], begin[r + 1]):
                own = chained(own, word[k])
        else:
            edge[r + 1] = edge[r]
            continue
        a, b = own[:, 0], own[:, 1]
        order = np.argsort(a)
        a, b = a[order], b[order]
        tied = a[1:] == a[:-1]
        if tied.any():
            if (tied & (b[1:] != b[:-1])).any():
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                tied = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            new = np.append(True, ~tied)
            a, b = a[new], b[new]
        first.append(a)
        second.append(b)
        edge[r + 1] = edge[r] + len(a)
    return np.concatenate(first), np.concatenate(second), edge


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes (a power of two) that start at each position."""
    h, step = BYTE_CODE[raw], 1
    while step < width:
        h = mix_pair(h[:-step], h[step:], step)
        step *= 2
    return h


def mix_pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a * U64(0x9FB21C651E98DF25 + 2 * salt) + b
    x ^= x >> U64(29)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, in log2(width) passes."""
    step, m = 1, x
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
