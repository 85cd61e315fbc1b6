"""Operator 4: exact n-gram Jaccard join and near-duplicate groups.

Sets of word shingles are compared in tiles. A tile holds the sets that share one shingle of
their prefix (two sets with Jaccard t or more share one of the first n - ceil(t n) + 1 shingles
in any common order), sorted by size, and pairs a set only with the band of sizes that t allows.
The common order puts frequent shingles last, so that boilerplate seldom makes a tile; the list
of frequent shingles is a bounded heuristic and does not touch the result. Tiles with the same
members are one tile, whatever shingle made them.

1. Inside its tile a pair is bounded by hashed bitmaps: each bit set in one bitmap only is a
   shingle the other set lacks, which bounds the overlap from above. A tile emits a spanning
   forest of the pairs that may link, never the pairs, so it has fewer rows than members.
2. The forests' components are clusters: linked sets are in one cluster. Each set goes to its
   cluster once, as a sorted array, and pairs there are bounded by bitmaps again and decided by
   an exact intersection. A cluster emits a spanning forest of its links.

In both steps the sets of a tile or cluster are taken in order of size, and each is compared with
the larger ones of its band that no link connects with it yet. Large tiles and clusters are dealt
in blocks, a task a pair of blocks. Equal sets are one node, so copies are never paired.

A shingle is 128 bits, made from 128 bits of the BLAKE2b digest of each of its words, and so are the
ids of sets (nodes) and rows (keys): no two texts are taken for each other because their words were
made to clash. Half of a shingle orders prefixes, tiles and bitmaps, where a clash costs a comparison;
what decides a link is the whole. Defined results: null and empty texts, and texts of white space,
have no shingles and stay alone; fewer words than the width make one shingle; very long texts
are one set each, whole; rows repeated with one doc_id are one document when their sets are
equal and keep a row each; several texts under one doc_id are a document each; a null doc_id links
like any other but never names a group unless all its members are null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import dealt, discard, documents, prefilter, slices, whole_groups, whole_text, written
from harborlight.llm.components import components
from harborlight.llm.kernels import U64, mix, shingle_lanes, utf8

WIDTH, PERCENT = 5, 75
#: Frequent shingles that are put last in the common order: at most so many 8-byte hashes.
HEAVY, HEAVY_ROWS = 1 << 16, 4
#: Bits of a bitmap: eight a shingle up to 2048, two a shingle beyond, at most 65536.
BITS = (64, 2048, 1 << 16)
#: Members of a tile or cluster beyond which it is dealt in blocks.
BLOCK = 1024
#: Shingles of one bucket of postings, about, and rows of a shingle beyond which its postings are not
#: gathered: each becomes a row of the shingle's tile where it is.
BUCKET, HOT = 1 << 22, 1 << 20


def need(a, b, percent: int = PERCENT):
    """The least overlap of linked sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(values: np.ndarray) -> bytes:
    """Bits at the hashes' low ends; the width is a power of two."""
    dense, sparse = (1 << int(k * max(len(values), 1) - 1).bit_length() for k in (8, 2))
    width = min(max(BITS[0], min(dense, max(BITS[1], sparse))), BITS[2])
    bits = np.zeros(width, bool)
    bits[(values & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps as a matrix for each width, so that many pairs are bounded at once."""

    def __init__(self, bitmaps: list[bytes]):
        words = np.array([len(b) // 8 for b in bitmaps], np.int64)
        self.widths, self.kind = np.unique(words, return_inverse=True)
        self.place, self.rows = np.zeros(len(words), np.int64), []
        for k, w in enumerate(self.widths):
            at = np.flatnonzero(self.kind == k)
            self.place[at] = np.arange(len(at))
            self.rows.append(np.frombuffer(b"".join([bitmaps[i] for i in at]), np.uint64).reshape(len(at), w))

    def most_overlap(self, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """An upper bound of the overlap of the sets i[k] and j[k], from their bitmaps and sizes.

        The wider bitmap of a pair is folded to the narrower one's width.
        """
        out = np.minimum(n[i], n[j]).astype(np.int64)
        both = self.kind[i] * len(self.widths) + self.kind[j]
        for kinds in np.unique(both):
            ki, kj = divmod(int(kinds), len(self.widths))
            pairs = np.flatnonzero(both == kinds)
            step = max(1, (1 << 21) // int(max(self.widths[ki], self.widths[kj])))
            for part in (pairs[k : k + step] for k in range(0, len(pairs), step)):
                x, y = self.rows[ki][self.place[i[part]]], self.rows[kj][self.place[j[part]]]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
                only_x = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
                only_y = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                out[part] = np.minimum(n[i[part]] - only_x, n[j[part]] - only_y)
        return out


def node_ids(first: np.ndarray, second: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """128 bits per set (two words a row): equal sets have equal ids; zero for empty sets."""
    n = np.diff(edge)
    sums = np.zeros((len(first) + 1, 2), U64)
    np.cumsum(mix(first ^ mix(second)), out=sums[1:, 0])
    np.cumsum(mix(second + mix(first ^ U64(0x5851F42D4C957F2D))), out=sums[1:, 1])
    out = mix(sums[edge[1:]] - sums[edge[:-1]] + n.astype(U64)[:, None])
    out[n == 0] = 0
    return out


NODE = pa.decimal128(38)


def numbers(words: np.ndarray) -> pa.Array:
    """Rows of two words as numbers below 2 ** 126, which fit Spark's decimal(38, 0)."""
    low_high = np.empty((len(words), 2), U64)
    low_high[:, 0], low_high[:, 1] = words[:, 0], words[:, 1] >> U64(2)
    return pa.Array.from_buffers(NODE, len(words), [None, pa.py_buffer(low_high)])


def row_key() -> Column:
    """A row's key of 120 bits: doc_ids may be null or shared by several texts."""
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), whole_text()), 256)
    high, low = (F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16))
    return (high * F.lit(1 << 60).cast("decimal(38,0)") + low).cast("decimal(38,0)")


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key, node, n, bitmap a row; the first row of a slice also has its frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                values, others, edge = shingle_lanes(*utf8(piece.column(1)), width)
                token, count = np.unique(values, return_counts=True)
                often = count >= HEAVY_ROWS
                heavy = [[{"token": t, "rows": c} for t, c in zip(token[often].view(np.int64).tolist(), count[often].tolist())]]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), piece.column(2), numbers(node_ids(values, others, edge)), pa.array(np.diff(edge).astype(np.int32)),
                        pa.array([bitmap(values[a:b]) for a, b in zip(edge, edge[1:])], pa.binary()),
                        pa.array(heavy + [None] * (len(edge) - 2), pa.list_(pa.struct([("token", pa.int64()), ("rows", pa.int32())]))),
                    ],
                    ["doc_id", "key", "node", "n", "bitmap", "heavy"],
                )

    return docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key decimal(38,0), node decimal(38,0), n int, bitmap binary, heavy array<struct<token: long, rows: int>>")


def postings(docs: DataFrame, heavy: np.ndarray, width: int, percent: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(shingle, node, n) of every prefix, packed by slice and bucket of the shingle.

    Of a shingle's hash 32 bits are kept beside its bucket: two that share them share a tile, which
    costs a comparison and changes no result. Postings of hot shingles are dealt to as many further
    buckets by their node.
    """
    hot = np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                values, others, edge = shingle_lanes(*utf8(piece.column(0)), width)
                nodes, sizes = node_ids(values, others, edge), np.diff(edge)
                _, once = np.unique(nodes, axis=0, return_index=True)
                last, tokens, rows = np.isin(values, heavy, assume_unique=False), [], []
                for r in once:
                    if n := int(sizes[r]):
                        own, late = values[edge[r] : edge[r + 1]], last[edge[r] : edge[r + 1]]
                        first = np.concatenate((own[~late], own[late]))[: n - (-(-percent * n // 100)) + 1]
                        tokens.append(first)
                        rows.append(np.full(len(first), r))
                if not tokens:
                    continue
                token, row = np.concatenate(tokens), np.concatenate(rows)
                bucket = (mix(token) % U64(buckets)).astype(np.int64)
                if len(hot):
                    far = np.isin(token, hot)
                    bucket[far] = buckets + (nodes[row[far], 0] % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                token, row, bucket = token[order], row[order], bucket[order]
                start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                stop = np.append(start[1:], len(bucket))
                token, node, size = token.astype(np.uint32), nodes[row], sizes[row].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[start].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(start, stop)], pa.binary()) for x in (token, node, size))],
                    ["bucket", "tokens", "nodes", "sizes"],
                )

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, nodes binary, sizes binary")


def tiles(packed: DataFrame, percent: int, buckets: int, hot: dict[int, int]) -> DataFrame:
    """tile, members, node, n of every tile with two sets whose sizes fit.

    tile is a hash of the members, so that tiles with the same members are one. hot: about how many
    rows each hot shingle has, by the 32 bits of its postings; its tile is named by these.
    """
    hot_tokens = np.array(sorted(hot), np.uint32)
    hot_rows = np.array([hot[t] for t in sorted(hot)], np.int32)

    def apart(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = hot_rows[np.searchsorted(hot_tokens, token)]
        tile = mix(token.astype(U64) + U64(0xA24BAED4963EE407))
        for i in range(0, len(token), 1 << 17):
            part = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(tile[part].view(np.int64)), pa.array(rows[part]), numbers(node[part]), pa.array(n[part])], ["tile", "members", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 0):
            token, node, n = (np.frombuffer(b"".join(held.column(k).to_pylist()), t) for k, t in ((1, "<u4"), (2, "<u8"), (3, "<i4")))
            node = node.reshape(-1, 2)
            if len(hot_tokens):
                far = np.repeat(held.column(0).to_numpy() >= buckets, [len(x) // 4 for x in held.column(1).to_pylist()])
                yield from apart(token[far], node[far], n[far])
                token, node, n = token[~far], node[~far], n[~far]
            order = np.lexsort((node[:, 1], node[:, 0], n, token))
            token, node, n = token[order], node[order], n[order]
            new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]).any(1))
            token, node, n = token[new], node[new], n[new]
            same = token[1:] == token[:-1]
            near = same & (percent * n[1:].astype(np.int64) <= 100 * n[:-1].astype(np.int64))
            fits = np.append(near, False) | np.append(False, near)
            token, node, n = token[fits], node[fits], n[fits]
            if not len(token):
                continue
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            tile = np.add.reduceat(mix(node[:, 0] ^ mix(node[:, 1])), start)
            count = np.diff(np.append(start, len(token)))
            _, once = np.unique(tile, return_index=True)
            rows = np.concatenate([np.arange(a, a + c) for a, c in zip(start[once], count[once])])
            of = np.repeat(once, count[once])
            for i in range(0, len(rows), 1 << 17):
                r, t = rows[i : i + (1 << 17)], of[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(tile[t].view(np.int64)), pa.array(count[t].astype(np.int32)), numbers(node[r]), pa.array(n[r])], ["tile", "members", "node", "n"])

    rows = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "tile long, members int, node decimal(38,0), n int")
    return rows.dropDuplicates(["tile", "members", "node"])


def spanning(part: np.ndarray, n: np.ndarray, side: np.ndarray, split: np.ndarray, percent: int, close: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that span every part's components under `close`, for rows sorted by part and n.

    Round r takes the r-th row of every part and compares it with the later ones in the band of
    its size that are not connected with it yet; parts that are connected drop out. So any two
    rows that are never compared are connected already.
    """
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(part))))
    component, most = np.arange(len(part)), 100 * n // percent
    left, right = [], []
    at, turn = np.arange(len(part)), start.copy()  # rows still in play; the row whose turn it is
    while True:
        # rows from their part's turn on, of parts with several components left
        at = at[at >= turn[group[at]]]
        if not len(at):
            break
        head = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1]))
        several = np.minimum.reduceat(component[at], head) < np.maximum.reduceat(component[at], head)
        at = at[np.repeat(several, np.diff(np.append(head, len(at))))]
        first = turn[group[at]]
        meet = (at > first) & (n[at] <= most[first]) & (component[at] != component[first]) & (~split[at] | (side[at] != side[first]))
        i, j = first[meet], at[meet]
        hit = close(i, j)
        i, j = i[hit], j[hit]
        if len(i):
            old, once = np.unique(component[j], return_index=True)
            left.append(i[once])
            right.append(j[once])
            # a component lies in one part, so each joins one row's component
            spot = np.minimum(np.searchsorted(old, component[at]), len(old) - 1)
            component[at] = np.where(old[spot] == component[at], component[i[once]][spot], component[at])
        turn += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges a < b that span the groups of every part. rows: part, n, node, side, split, content.

    content is a bitmap, and edges are pairs it allows; or, if exact, the shingles sorted by their
    first words, and edges are links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 0):
            part, n, side, split = (held.column(k).to_numpy() for k in range(4))
            n, node, content = n.astype(np.int64), held.column(4), held.column(5).to_pylist()
            sets = [np.frombuffer(x, "<u8").reshape(2, -1) for x in content] if exact else []
            maps = Bitmaps([bitmap(s[0]) for s in sets] if exact else content)

            def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                out = maps.most_overlap(n, i, j) >= need(n[i], n[j], percent)
                if exact:
                    ask = np.flatnonzero(out)
                    out[ask] = overlaps(sets, i[ask], j[ask]) >= need(n[i[ask]], n[j[ask]], percent)
                return out

            i, j = spanning(part, n, side, split, percent, close)
            yield from pa.table([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"]).to_batches()

    rows = rows.select("part", "n", "side", "split", "node", "content")
    return rows.repartition("part").sortWithinPartitions("part", "n", "node").mapInArrow(run, "a decimal(38,0), b decimal(38,0)")


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the sets i[k] and j[k], for ascending i.

    A set has a row for each word of its shingles, two here, and is sorted by the first.
    """
    sets = [np.atleast_2d(s) for s in sets]
    out = np.zeros(len(i), np.int64)
    edge = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i)) if len(i) else [0]
    for a, b in zip(edge, edge[1:]):
        one, at = sets[i[a]], int(a)
        same_first = (one[0, 1:] == one[0, :-1]).any()
        while at < b:  # at most a million shingles at once, unless one set has more
            size = np.cumsum([sets[k].shape[1] for k in j[at:b]])
            to = at + max(1, int(np.searchsorted(size, 1 << 20, side="right")))
            others = np.concatenate([sets[k] for k in j[at:to]], axis=1)
            if same_first:  # two shingles of a set share their first word: compare both at once
                found = np.isin(pairs(others), pairs(one))
            else:
                place = np.minimum(np.searchsorted(one[0], others[0]), one.shape[1] - 1)
                found = (one[0][place] == others[0]) & (one[-1][place] == others[-1])
            out[at:to] = np.add.reduceat(found, np.append(0, size[: to - at - 1]))
            at = to
    return out


def pairs(words: np.ndarray) -> np.ndarray:
    """The columns of two rows of words as one sortable value each."""
    return np.ascontiguousarray(words.T).astype("<u8").view([("first", "<u8"), ("second", "<u8")]).ravel()


def arrays(docs: DataFrame, holders: DataFrame, width: int) -> DataFrame:
    """holders (key, node, cluster, members) with n and content: the sorted shingles of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                values, others, edge = shingle_lanes(*utf8(piece.column(0)), width)
                content = pa.array([values[a:b].tobytes() + others[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(np.diff(edge).astype(np.int32)), content], ["node", "cluster", "members", "n", "content"])

    texts = prefilter(docs, holders, "key").dropDuplicates(["key"]).join(holders.hint("merge"), "key")
    return texts.select("text", "node", "cluster", "members").mapInArrow(run, "node decimal(38,0), cluster decimal(38,0), members long, n int, content binary")


def with_members(clusters: DataFrame) -> DataFrame:
    """clusters (node, component) as node, cluster, members; only the size of large ones is joined."""
    large = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK)
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = clusters.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(large, ["component", "salt"], "left")
    return rows.select("node", F.col("component").alias("cluster"), F.coalesce("members", F.lit(1)).cast("long").alias("members"))


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), node, key, leads of every
    document. leads: whether it stays for its group, as the first by doc_id (null last) and key."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), row_key().alias("key"))
    signed = written(signatures(docs, width), "signatures")
    often = signed.select(F.inline("heavy")).groupBy("token").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "token").limit(HEAVY)
    often = [(r["token"], r["rows"]) for r in often.collect()]  # at most HEAVY pairs of numbers
    heavy = np.array([t for t, _ in often], np.int64).view(U64)
    hottest = {int(t) & 0xFFFFFFFF: min(n, 2**31 - 1) for t, n in often if n > hot}
    far = np.array([t for t, n in often if n > hot], np.int64).view(U64)
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]  # one number
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1)
    tile = written(tiles(postings(docs, heavy, width, percent, buckets, far), percent, buckets, hottest), "tiles")
    nodes = written(signed.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("bitmap").alias("bitmap")), "nodes")
    rows = signed.select("doc_id", "key", "n", "node")
    near = written(forest(dealt(tile.join(nodes.select("node", F.col("bitmap").alias("content")), "node"), "tile", "node", BLOCK), percent, exact=False), "candidates")
    discard(tile)
    clusters = components(near)
    holders = written(with_members(clusters).join(nodes.select("node", "key"), "node"), "holders")
    links = written(forest(dealt(arrays(docs, holders, width), "cluster", "node", BLOCK), percent, exact=True), "links")
    discard(nodes, near, clusters, holders)
    groups = components(links)
    return named(rows, groups)


#: Parts that the rows of a large group are dealt to when they get its name.
SALTS = 32


def named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (doc_id, key, n, node) with the smallest doc_id of their group."""
    rows = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")), "labelled")
    alone, together = rows.where("n = 0"), rows.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    least = together.groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.max("node").alias("node"))
    least = least.select("component", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("lead"), "size", "n", "node")
    single = least.where("size = 1").select(F.col("component_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id", "node", F.col("lead").alias("key"), F.lit(True).alias("leads"))
    several = least.where("size > 1").select("component", "component_id", "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = together.join(several, ["component", "salt"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "node", "key", (F.col("key") == F.col("lead")).alias("leads"))
    return single.unionByName(shared).unionByName(alone.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node", "key", F.lit(True).alias("leads")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).drop("node", "key", "leads")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN s x ON o.a = x.doc_id JOIN s y ON o.b = y.doc_id WHERE 100 * o >= 75 * (len(x.s) + len(y.s) - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON s.doc_id = c.a
"""
