"""Operator 6: SentencePiece encoding and decoding by suffix-array matching.

The model file's pieces are matched, not its library: the texts of a batch are cut where no
piece can reach across (in front of a run of spaces), and the distinct strings that result are
joined and indexed by a suffix array. Every piece is binary-searched for its range of
occurrences; the ranges give edges (position, length, piece), which are sorted by position.
Relaxation then joins, in every string, the adjacent pair whose edge has the best score, leftmost
first, until no edge fits: the merge order of a byte-pair model. Short strings take a step each
at the same time; a string of more than TOGETHER characters keeps its pairs in a heap, over the
same edges. Strings that the worker has met before are remembered (REMEMBERED bytes at most) and
not indexed again.

Defined results: a null or empty text has no ids; characters outside the vocabulary become byte
pieces, so decoding gives every text back (but for the mark U+2581, which the format reads as a
space); very long texts and strings without spaces are encoded
whole; repeated rows are encoded alike; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import documents, slices, whole_text
from harborlight.llm.runindex import joined, packed_words, suffix_array

SPACE = "▁"
#: Strings up to this many characters are relaxed in step; longer ones with a heap each.
TOGETHER = 64
#: Bytes of strings and ids that a worker remembers, OVERHEAD bytes a string counted in.
REMEMBERED, OVERHEAD = 160 << 20, 200


class Pieces:
    """Vocabulary of a SentencePiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule, kinds = model.normalizer_spec, model.trainer_spec
        if kinds.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not kinds.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback and without normalisation are supported")
        normal = [(p.piece.encode(), i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces if p.type == 1):
            raise ValueError("a piece reaches across a space")
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type == 1 else b"" for p in model.pieces]
        self.names = [n for n, _, _ in normal]
        self.ids = np.array([i for _, i, _ in normal], np.int64)
        levels = sorted({-s for _, _, s in normal})
        place = {s: k for k, s in enumerate(levels)}
        self.level = np.array([place[-s] for _, _, s in normal], np.int64)  # smaller is better
        self.size = np.array([len(n) for n in self.names], np.int64)
        self.span = int(self.size.max()) + 1  # edges are keyed by position * span + length
        self.known: dict[str, bytes] = {}  # strings encoded before in this process
        self.held = 0  # their bytes
        text, start = joined(self.names)
        words = packed_words(text)
        # piece bytes in words of seven symbols, and what masks the rest of a suffix's word
        self.words = np.stack([words[start + 7 * k] & self.mask(self.size - 7 * k) for k in range(-(-int(self.size.max()) // 7))])

    @staticmethod
    def mask(left: np.ndarray) -> np.ndarray:
        left = np.clip(left, 0, 7)
        return np.where(left > 0, (np.int64(-1) << (9 * (7 - left))) & ((np.int64(1) << 62) - 1 | np.int64(1) << 62), 0)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece) of every occurrence of every piece, sorted by position."""
        order = suffix_array(text)
        words = packed_words(text)
        low = self.search(order, words, False)
        high = self.search(order, words, True)
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        at = order[low[piece] + nth]
        by = np.lexsort((self.size[piece], at))
        return at[by], self.size[piece][by], piece[by]

    def search(self, order: np.ndarray, words: np.ndarray, behind: bool) -> np.ndarray:
        """First suffix that is not below each piece, or the first behind those it starts."""
        low, high = np.zeros(len(self.names), np.int64), np.full(len(self.names), len(order), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            at = order[middle]
            sign = np.zeros(len(live), np.int64)
            for k, own in enumerate(self.words):
                left = self.size[live] - 7 * k
                tied = (sign == 0) & (left > 0)
                if not tied.any():
                    break
                held = words[at + 7 * k] & self.mask(left)
                sign = np.where(tied, np.sign(held - own[live]), sign)
            below = (sign < 0) | (behind & (sign == 0))
            low[live] = np.where(below, middle + 1, low[live])
            high[live] = np.where(below, high[live], middle)

    def remembered(self, strings: list[str]) -> dict[str, bytes]:
        """Ids of the strings, of which new ones alone are encoded."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = [s for s in dict.fromkeys(strings) if s not in self.known]
        ids = self.relax([s.encode() for s in new])
        self.held += sum(len(s) + len(i) for s, i in zip(new, ids)) + OVERHEAD * len(new)
        self.known.update(zip(new, ids))
        return self.known

    def relax(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each string as little-endian unsigned 16-bit values, as the model's merges give."""
        if not raw:
            return []
        text, start = joined(raw)
        at, length, piece = self.edges(text)
        key = at * self.span + length
        # symbols: their first bytes, the string they are in; the end is where the next one begins
        is_first = (text > 0) & ~((text > 128) & (text <= 192))
        a = np.flatnonzero(is_first)
        owner = np.searchsorted(start, a, side="right") - 1
        stop = np.append(start[1:], len(text)) - 1
        worst = np.int64(1) << 40

        def rank(left: np.ndarray, right_end: np.ndarray) -> np.ndarray:
            if not len(key):
                return np.full(len(left), worst)
            k = left * self.span + (right_end - left)
            i = np.minimum(np.searchsorted(key, k), len(key) - 1)
            return np.where((right_end - left < self.span) & (key[i] == k), self.level[piece[i]], worst)

        final_a, final_owner = [], []
        long = np.bincount(owner, minlength=len(raw)) > TOGETHER
        for o in np.flatnonzero(long):
            lo, hi = np.searchsorted(key, (start[o] * self.span, (stop[o] + 1) * self.span))
            mine = slice(*np.searchsorted(owner, (o, o + 1)))
            left = self.one(a[mine].tolist(), int(stop[o]), dict(zip(key[lo:hi].tolist(), self.level[piece[lo:hi]].tolist())))
            final_a.append(left)
            final_owner.append(np.full(len(left), o))
        a, owner = a[~long[owner]], owner[~long[owner]]
        while len(a):
            last = np.append(owner[1:] != owner[:-1], True)
            end = np.where(last, stop[owner], np.append(a[1:], 0))
            after = np.append(end[1:], 0)  # where the next symbol ends
            level = np.where(last, worst, worst)
            inner = np.flatnonzero(~last)
            level[inner] = rank(a[inner], after[inner])
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(level, head)
            group = np.cumsum(np.append(0, (owner[1:] != owner[:-1]).astype(np.int64)))
            through = best[group] == worst
            final_a.append(a[through])
            final_owner.append(owner[through])
            # leftmost symbol with the best level in each string takes its neighbour in
            hit = np.flatnonzero((level == best[group]) & ~through)
            first = hit[np.append(True, group[hit][1:] != group[hit][:-1])] if len(hit) else hit
            keep = ~through
            keep[first + 1] = False
            a, owner = a[keep], owner[keep]
        a, owner = np.concatenate(final_a) if final_a else a, np.concatenate(final_owner) if final_owner else owner
        order = np.argsort(a, kind="stable")
        a, owner = a[order], owner[order]
        last = np.append(owner[1:] != owner[:-1], True) if len(a) else np.zeros(0, bool)
        end = np.where(last, stop[owner], np.append(a[1:], 0)) if len(a) else a
        k = a * self.span + (end - a)
        i = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
        known = (key[i] == k) & (end - a < self.span) if len(key) else np.zeros(len(a), bool)
        size = np.where(known, 1, end - a)  # byte pieces for what the vocabulary lacks
        ids = np.repeat(self.ids[piece[i]] if len(key) else np.zeros(len(a), np.int64), size)
        spot = np.repeat(a, size) + np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        unknown = np.repeat(~known, size)
        table = np.array([self.bytes_id[b] for b in range(256)], np.int64)
        ids[unknown] = table[text[spot[unknown]].astype(np.int64) - 1]
        edge = np.append(0, np.cumsum(np.bincount(np.repeat(owner, size), minlength=len(raw)))).tolist()
        whole = ids.astype("<u2").tobytes()
        return [whole[2 * x : 2 * y] for x, y in zip(edge, edge[1:])]

    def one(self, first: list[int], stop: int, levels: dict[int, int]) -> np.ndarray:
        """Where the symbols of one string start in the end. first: where its characters start;
        levels: the level of each of its edges. The heap holds (level, left start, right end)."""
        end = dict(zip(first, [*first[1:], stop]))  # of the symbol that starts there
        begin = {e: f for f, e in end.items()}  # of the symbol that ends there
        heap: list[tuple[int, int, int, int]] = []

        def push(left: int, middle: int) -> None:
            right = end.get(middle)
            if right is not None and right - left < self.span and (level := levels.get(left * self.span + right - left)) is not None:
                heapq.heappush(heap, (level, left, middle, right))

        for f in first:
            push(f, end[f])
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if end.get(left) != middle or end.get(middle) != right:
                continue
            del end[middle], begin[middle]
            end[left], begin[right] = right, left
            if (before := begin.get(left)) is not None:
                push(before, left)
            push(left, right)
        return np.array(list(end), np.int64)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def strings_of(text: str) -> list[str]:
    """The text with its leading space mark, cut in front of every run of space marks."""
    if not text:
        return []
    words = text.split(" ")
    if "" not in words and SPACE not in text:
        return [SPACE + w for w in words]
    return RUNS.findall(SPACE + text.replace(" ", SPACE))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 16-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for piece in slices(batch):
                cut = [strings_of(t) for t in piece.column(1).to_pylist()]
                known = pieces.remembered([s for c in cut for s in c])
                ids = [b"".join([known[s] for s in c]) for c in cut]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids binary")


def round_trip(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned 32-bit ids), decoded_sha256, lossless of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            rows = []
            for doc, text, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<u2")
                back = pieces.decode(ids)
                rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = default_model()
    return round_trip(encode(documents(spark, sf_dir), model), model)
