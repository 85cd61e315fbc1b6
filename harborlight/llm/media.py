"""Operator 2: media columns in ISO base media containers.

store() turns each text's bytes into a track of fixed-size 8-bit samples inside an ISO media
file (ftyp, mdat, moov with the full tree of nested boxes and sample tables). probe() is a
reader for any such file: it walks nested boxes (32-bit, 64-bit and to-end sizes), decodes the
sample tables (stts, stsc, stsz, stco or co64, stss; trex, tfhd and trun of fragmented files) and
returns codec, duration, dimensions and the byte range of every keyframe of every track, without
touching the payload. payload() reads the samples back through those tables.

The stored form depends on the bytes alone (no clock, no random ids), so equal texts give equal
files. Defined results: a null or empty text is stored as one sample of spaces; very long texts
take a 64-bit media box from 4 GiB on; repeated rows are stored alike; a null doc_id stays
null; bytes that are no ISO media file, or whose tables do not fit their boxes or the file, are
reported in `error` with null columns, before anything of the size they claim is allocated; store()
ignores extra columns, probe() and read_back() keep all but those they make themselves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from harborlight.llm.common import documents, whole_text, written

SAMPLE, RATE, CHUNK, KEY_EVERY = 192, 48, 16, 12  # bytes a sample, samples a second, samples a chunk, samples between keyframes
WIDTH, HEIGHT = 16, 12
CODEC = b"raw "
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
DEEPEST = 32  # boxes inside each other; the format's own go 6 deep
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def encode(data: bytes) -> bytes:
    """An ISO media file with data, padded with spaces to a positive multiple of SAMPLE."""
    data = data.ljust(max(SAMPLE, -(-len(data) // SAMPLE) * SAMPLE), b" ")
    n = len(data) // SAMPLE
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    media = box(b"mdat", data)
    origin = len(head) + len(media) - len(data)
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    offsets = origin + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE
    wide = int(offsets[-1]) >= 1 << 32
    keys = np.arange(1, n + 1, KEY_EVERY)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", WIDTH, HEIGHT), struct.pack(">IIIH", 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    tables = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(16), UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=1, flags=7)
    mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
    return head + media + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path of box types, start, start of body, end) of every box, depth first."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise ValueError("a 64-bit box size is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} leaves its parent")
        todo.append((stop, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise ValueError("boxes are nested too deep")
            todo.append((body, stop, (*path, kind)))
        yield (*path, kind), start, body, stop


@dataclass(frozen=True)
class Track:
    codec: str
    seconds: float
    width: int
    height: int
    offsets: np.ndarray  # byte offset of each sample
    sizes: np.ndarray
    keys: np.ndarray  # indexes of keyframes

    def ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[k]), int(self.sizes[k])) for k in self.keys]


def table(data: memoryview, at: int, end: int, kind: str, columns: int = 1, head: int = 4) -> np.ndarray:
    if at + head + 4 > end:
        raise ValueError("a sample table is cut off")
    (n,) = struct.unpack_from(">I", data, at + head)
    if at + head + 4 + n * columns * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table leaves its box")
    rows = np.frombuffer(data, kind, n * columns, at + head + 4).astype(np.int64)
    return rows.reshape(n, columns) if columns > 1 else rows


def tracks(raw: bytes) -> list[Track]:
    """The tracks of an ISO media file; ValueError for anything else."""
    data = memoryview(raw)
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, ...]] = {}
    fragments: list[dict] = []
    moof = 0
    try:
        for path, start, at, end in walk(data):
            if path == (b"moov", b"trak"):
                found.append({})
            elif path[:2] == (b"moov", b"trak") and found:
                if path[-1] != b"hdlr" or path[-2] == b"mdia":  # a handler of data comes in minf, too
                    found[-1].setdefault(path[-1], (at, end))
            elif path == (b"moov", b"mvex", b"trex"):
                track_id, *rest = struct.unpack_from(">5I", data, at + 4)
                defaults[track_id] = tuple(rest[1:])  # duration, size, flags
            elif path == (b"moof",):
                moof = start
            elif path == (b"moof", b"traf"):
                fragments.append({"moof": moof, "runs": []})
            elif path == (b"moof", b"traf", b"tfhd"):
                fragments[-1]["head"] = (at, end)
            elif path == (b"moof", b"traf", b"trun"):
                fragments[-1]["runs"].append((at, end))
        if not found:
            raise ValueError("no track")
        return [track(data, boxes, parsed(data, fragments, defaults)) for boxes in found]
    except (struct.error, KeyError, IndexError, OverflowError) as e:
        raise ValueError(f"not an ISO media file: {e}") from e


def parsed(data: memoryview, fragments: list[dict], defaults: dict[int, tuple[int, ...]]) -> list[tuple]:
    """(track id, offsets, sizes, ticks, keyframes) of each track fragment.

    Offsets count from where the fragment says, or from its moof, or, behind another track's fragment in
    the same moof, from the end of that one's data.
    """
    out, moof, end = [], None, 0
    for f in fragments:
        if f["moof"] != moof:
            moof = end = f["moof"]
        head = f["head"][0]
        flags, number = struct.unpack_from(">II", data, head)
        base = moof if flags & 0x20000 else end
        offsets, sizes, spans, sync, end = fragment(data, f, base, defaults.get(number, (0, 0, 0)))
        out.append((number, offsets, sizes, spans, sync))
    return out


def dimensions(data: memoryview, boxes: dict[bytes, tuple[int, int]], entry: int) -> tuple[int, int]:
    """Of a video track (or one without a handler) its sample entry's; of any other the track header's."""
    if b"hdlr" not in boxes or bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]) == b"vide":
        return struct.unpack_from(">HH", data, entry + 32)
    at, end = boxes[b"tkhd"]
    spot = at + (88 if data[at] == 1 else 76)
    return tuple(x >> 16 for x in struct.unpack_from(">II", data, spot)) if spot + 8 <= end else (0, 0)


def track(data: memoryview, boxes: dict[bytes, tuple[int, int]], fragments: list[tuple] = ()) -> Track:
    at, _ = boxes[b"mdhd"]
    rate, ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, end = boxes[b"stsd"]
    if at + 44 > end:
        raise ValueError("no sample entry")
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    width, height = dimensions(data, boxes, at + 8)
    at, end = boxes[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, at + 4)
    if fixed and n * fixed > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(n, fixed, np.int64) if fixed else table(data, at, end, ">u4", head=8)
    chunk_at = table(data, *boxes[b"stco"], ">u4") if b"stco" in boxes else table(data, *boxes[b"co64"], ">u8")
    runs = table(data, *boxes[b"stsc"], ">u4", 3)
    starts = runs[:, 0] - 1
    if len(runs) and (starts[0] != 0 or (np.diff(starts) <= 0).any() or starts[-1] >= len(chunk_at)):
        raise ValueError("the runs of chunks are out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(starts, len(chunk_at)))) if len(runs) else np.zeros(len(chunk_at), np.int64)
    if per.sum() != n:
        raise ValueError("the chunks hold another number of samples")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    held = per > 0
    offsets = np.repeat(chunk_at[held] - before[first[held]], per[held]) + before
    keys = table(data, *boxes[b"stss"], ">u4") - 1 if b"stss" in boxes else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe is no sample")
    times = table(data, *boxes[b"stts"], ">u4", 2).tolist()
    length = sum(a * b for a, b in times)
    at, _ = boxes[b"tkhd"]
    (track_id,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    for number, more_at, more, spans, sync in fragments:
        if number == track_id:
            keys = np.append(keys, len(sizes) + np.flatnonzero(sync))
            offsets, sizes, length = np.append(offsets, more_at), np.append(sizes, more), length + sum(spans)
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample leaves the file")
    return Track(codec, (length or ticks) / rate if rate else 0.0, width, height, offsets, sizes, keys)


def fragment(data: memoryview, traf: dict, base: int, default: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, int]:
    """offset, size, ticks and whether it is a keyframe, of the samples of one track fragment, and
    where its data ends."""
    at, _ = traf["head"]
    flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
    spot, own = at + 8, list(default)
    if flags & 1:
        (base,), spot = struct.unpack_from(">Q", data, spot), spot + 8
    spot += 4 if flags & 2 else 0
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            (own[k],), spot = struct.unpack_from(">I", data, spot), spot + 4
    offsets, sizes, spans, sync, where = [], [], [], [], base
    for at, end in traf["runs"]:
        flags, n = struct.unpack_from(">II", data, at)
        flags, spot = flags & 0xFFFFFF, at + 8
        if flags & 1:
            where, spot = base + struct.unpack_from(">i", data, spot)[0], spot + 4
        first = None
        if flags & 4:
            (first,), spot = struct.unpack_from(">I", data, spot), spot + 4
        held = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
        if spot + 4 * n * len(held) > end or (not held and n * max(1, own[1]) > len(data)):
            raise ValueError("a run of samples leaves its box")
        cells = np.frombuffer(data, ">u4", n * len(held), spot).astype(np.int64).reshape(n, len(held))
        columns = [cells[:, held.index(k)] if k in held else np.full(n, own[k], np.int64) for k in range(3)]
        if first is not None and n and 2 not in held:
            columns[2] = np.append(first, columns[2][1:])
        ends = where + np.cumsum(columns[1])
        offsets.append(ends - columns[1])
        sizes.append(columns[1])
        spans += columns[0].tolist()
        sync.append(columns[2] & 0x10000 == 0)
        where = int(ends[-1]) if n else where
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *offsets]), np.concatenate([none, *sizes]), spans, np.concatenate([np.zeros(0, bool), *sync]), where


def payload(raw: bytes, t: Track) -> bytes:
    """The samples in order. Neighbouring samples are read as one range."""
    if not len(t.offsets):
        return b""
    cut = np.flatnonzero(t.offsets[1:] != t.offsets[:-1] + t.sizes[:-1]) + 1
    first = np.append(0, cut)
    last = np.append(cut, len(t.offsets)) - 1
    return b"".join(raw[t.offsets[a] : t.offsets[b] + t.sizes[b]] for a, b in zip(first, last))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of each row as an ISO media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def each_media(media: DataFrame, schema: str, row: Callable[[bytes | None], tuple]) -> DataFrame:
    """The columns of `media` but the bytes and the names in schema, and what row() makes of the bytes."""
    added = StructType.fromDDL(schema)
    kept = [c for c in media.columns if c != "media" and c not in added.names]
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x) for x in batch.column(len(kept)).to_pylist()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, *added.names])

    out = StructType([*(media.schema[c] for c in kept), *added])
    return media.select(*kept, "media").mapInArrow(run, out)


RANGES = "array<struct<offset: bigint, size: bigint>>"


def keyframes(t: Track) -> list[dict]:
    return [{"offset": a, "size": b} for a, b in t.ranges()]


def probe(media: DataFrame) -> DataFrame:
    """tracks (codec, duration, width, height, samples, keyframes as offset and size) and error; no
    payload is read."""

    def row(raw: bytes | None) -> tuple:
        try:
            found = tracks(raw or b"")
        except ValueError as e:
            return None, str(e)
        return [{"codec": t.codec, "duration": t.seconds, "width": t.width, "height": t.height, "samples": len(t.sizes), "keyframes": keyframes(t)} for t in found], None

    return each_media(media, f"tracks array<struct<codec: string, duration: double, width: int, height: int, samples: bigint, keyframes: {RANGES}>>, error string", row)


def read_back(media: DataFrame) -> DataFrame:
    """codec, duration and keyframes of the first track, digests of its payload and of the stored
    form, and a feature line. Bytes that are no ISO media file give nulls."""

    def row(raw: bytes | None) -> tuple:
        try:
            t = tracks(raw or b"")[0]
        except ValueError:
            return (None,) * 9
        data = payload(raw, t)
        ranges = t.ranges()
        ends = f"first={ranges[0][0]}+{ranges[0][1]};last={ranges[-1][0]}+{ranges[-1][1]}" if ranges else "first=;last="
        mean = f"{np.frombuffer(data, np.uint8).mean():.4f}" if data else ""
        feature = f"codec={t.codec.strip()};seconds={t.seconds:.6f};size={t.width}x{t.height};samples={len(t.sizes)};keyframes={len(ranges)};{ends};mean={mean}"
        return t.codec, t.seconds, keyframes(t), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

    return each_media(media, f"codec string, duration double, keyframes {RANGES}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(store(documents(spark, sf_dir)), "media", "zstd"))
