"""Op2's reader on files it did not write itself: two tracks, fragments, and hostile boxes."""

import struct

import numpy as np
import pytest

from harborlight.llm import media as M
from harborlight.llm.common import prepare


def u4(*x):
    return struct.pack(f">{len(x)}I", *x)


def trak(number, codec, rate, sizes, chunks, runs, times, keys=None):
    """A track with version-0 headers and a size table of its own."""
    entry = M.box(codec, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 320, 240), bytes(50))
    tables = [
        M.full(b"stsd", u4(1), entry), M.full(b"stts", u4(len(times)), *(u4(*t) for t in times)), M.full(b"stsc", u4(len(runs)), *(u4(*r) for r in runs)),
        M.full(b"stsz", u4(0, len(sizes)), u4(*sizes)), M.full(b"co64", u4(len(chunks)), struct.pack(f">{len(chunks)}Q", *chunks)),
    ]
    if keys is not None:
        tables.append(M.full(b"stss", u4(len(keys)), u4(*keys)))
    mdia = M.box(b"mdia", M.full(b"mdhd", u4(0, 0, rate, 7, 0)), M.box(b"minf", M.box(b"stbl", *tables)))
    return M.box(b"trak", M.full(b"tkhd", u4(0, 0, number, 0, 0), bytes(60)), mdia)


DATA = bytes(range(256)) * 4


def test_two_tracks():
    head = M.box(b"ftyp", b"isom", u4(0))
    media = M.box(b"mdat", DATA)
    at = len(head) + 8
    video = trak(1, b"avc1", 1000, [10, 20, 30, 40], [at, at + 200], [(1, 3, 1), (2, 1, 1)], [(3, 40), (1, 80)], [1, 3])
    sound = trak(2, b"mp4a", 8000, [5, 5], [at + 100], [(1, 2, 1)], [(2, 4000)])
    raw = head + media + M.box(b"moov", video, sound)
    one, two = M.tracks(raw)
    assert (one.codec, one.seconds, one.width, one.height) == ("avc1", 0.2, 320, 240) and one.ranges() == [(at, 10), (at + 30, 30)]
    assert M.payload(raw, one) == DATA[:60] + DATA[200:240]
    assert (two.codec, two.seconds) == ("mp4a", 1.0) and two.ranges() == [(at + 100, 5), (at + 105, 5)] and M.payload(raw, two) == DATA[100:110]


@pytest.mark.parametrize("base_is_moof", [True, False])
def test_fragmented_file(base_is_moof):
    moov = M.box(b"moov", trak(1, b"avc1", 10, [], [], [], []), M.box(b"mvex", M.full(b"trex", u4(1, 1, 5, 7, 0x10000))))
    head = M.box(b"ftyp", b"isom", u4(0)) + moov

    def moof(first, second):
        tfhd = M.full(b"tfhd", u4(1), flags=0x20000) if base_is_moof else M.full(b"tfhd", u4(1), struct.pack(">Q", len(head)), flags=1)
        runs = M.full(b"trun", u4(3, first, 0), flags=5), M.full(b"trun", u4(2, second), u4(3, 20, 0, 4, 30, 0x10000), flags=0x701)
        return M.box(b"moof", M.full(b"mfhd", u4(1)), M.box(b"traf", tfhd, *runs))

    size = len(moof(0, 0))
    raw = head + moof(size + 8, size + 8 + 100) + M.box(b"mdat", DATA)
    (t,) = M.tracks(raw)
    at = len(head) + size + 8
    assert t.sizes.tolist() == [7, 7, 7, 20, 30] and t.offsets.tolist() == [at, at + 7, at + 14, at + 100, at + 120]
    assert t.keys.tolist() == [0, 3] and t.seconds == (15 + 7) / 10
    assert M.payload(raw, t) == DATA[:21] + DATA[100:150]


def patched(raw, kind, skip, value, size=4):
    at = raw.index(kind) + 4 + skip
    return raw[:at] + value.to_bytes(size, "big") + raw[at + size :]


GOOD = M.encode(b"x" * 5000)
DEEP = b""
for _ in range(1200):
    DEEP = M.box(b"moov", DEEP)
HOSTILE = {
    "deep": DEEP, "count": patched(GOOD, b"stsz", 8, 2**32 - 1), "size": patched(GOOD, b"stsz", 4, 2**31), "offset": patched(GOOD, b"stco", 8, 2**32 - 9), "entries": patched(GOOD, b"stco", 4, 2**32 - 1),
    "runs": patched(GOOD, b"stsc", 8, 9), "zero run": patched(GOOD, b"stsc", 8, 0), "key": patched(GOOD, b"stss", 8, 0), "key behind": patched(GOOD, b"stss", 8, 2**31), "times": patched(GOOD, b"stts", 4, 77),
    "cut": GOOD[:-1], "cut header": GOOD[:5], "empty": b"", "no track": M.box(b"ftyp", b"isom"), "long box": patched(GOOD, b"moov", -8, 2**31), "no entry": GOOD.replace(b"stsd", b"sts?"),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_boxes_are_refused(name):
    with pytest.raises(ValueError):
        M.tracks(HOSTILE[name])


def test_random_damage_never_crashes():
    rnd = np.random.default_rng(5)
    for _ in range(3000):
        raw = bytearray(GOOD)
        for _ in range(rnd.integers(1, 6)):
            raw[rnd.integers(len(raw) - 900, len(raw))] = rnd.integers(256)
        try:
            for t in M.tracks(bytes(raw)):
                assert len(M.payload(bytes(raw), t)) == t.sizes.sum()
        except ValueError:
            pass


def test_hostile_rows_and_clashing_columns(spark):
    prepare(spark)
    rows = [(i, bytearray(x), "c", "e") for i, x in enumerate([GOOD, *HOSTILE.values()])] + [(99, None, "c", "e")]
    table = spark.createDataFrame(rows, "doc_id long, media binary, codec string, error string")
    probed = {r.doc_id: r for r in M.probe(table).collect()}
    assert len(probed) == len(rows) and probed[0].error is None and all(r.error and r.tracks is None for i, r in probed.items() if i)
    back = {r.doc_id: r for r in M.read_back(table).collect()}
    assert back[0].codec == "raw " and all(r.payload_bytes is None for i, r in back.items() if i)


def handled(number, codec, handler, entry, width, height, sizes, chunks):
    """A track with a handler, a track header with dimensions, and a given sample entry."""
    n = len(sizes)
    tables = [M.full(b"stsd", u4(1), entry), M.full(b"stts", u4(1), u4(n, 100)), M.full(b"stsc", u4(1), u4(1, n, 1)), M.full(b"stsz", u4(0, n), u4(*sizes)), M.full(b"stco", u4(1), u4(*chunks))]
    data_handler = M.full(b"hdlr", u4(0), b"url ", bytes(13))
    mdia = M.box(b"mdia", M.full(b"mdhd", u4(0, 0, 44100, 7, 0)), M.full(b"hdlr", u4(0), handler, bytes(13)), M.box(b"minf", data_handler, M.box(b"stbl", *tables)))
    return M.box(b"trak", M.full(b"tkhd", u4(0, 0, number, 0, 0), bytes(52), u4(width << 16, height << 16)), mdia)


def test_dimensions_are_of_pictures():
    sound = M.box(b"mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHH", 2, 16, 0, 0), u4(44100 << 16))
    video = M.box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 640, 360), bytes(50))
    head, media = M.box(b"ftyp", b"isom", u4(0)), M.box(b"mdat", DATA)
    at = len(head) + 8
    raw = head + media + M.box(b"moov", handled(1, b"mp4a", b"soun", sound, 0, 0, [9], [at]), handled(2, b"avc1", b"vide", video, 320, 180, [9], [at]), handled(3, b"text", b"text", sound, 200, 40, [9], [at]))
    assert [(t.codec, t.width, t.height) for t in M.tracks(raw)] == [("mp4a", 0, 0), ("avc1", 640, 360), ("mp4a", 200, 40)]


def test_long_moof_and_fragments_of_two_tracks():
    """A moof with a 64-bit size; the second track's data follows the first one's where nothing else is said."""
    moov = M.box(b"moov", trak(1, b"avc1", 10, [], [], [], []), trak(2, b"mp4a", 10, [], [], [], []), M.box(b"mvex", M.full(b"trex", u4(1, 1, 5, 7, 0)), M.full(b"trex", u4(2, 1, 5, 3, 0))))
    head = M.box(b"ftyp", b"isom", u4(0)) + moov

    def moof(first):
        one = M.box(b"traf", M.full(b"tfhd", u4(1)), M.full(b"trun", u4(2, first), flags=1))
        two = M.box(b"traf", M.full(b"tfhd", u4(2)), M.full(b"trun", u4(4)))
        body = M.full(b"mfhd", u4(1)) + one + two
        return struct.pack(">I4sQ", 1, b"moof", 16 + len(body)) + body

    size = len(moof(0))
    raw = head + moof(size + 8) + M.box(b"mdat", DATA)
    video, sound = M.tracks(raw)
    at = len(head) + size + 8
    assert video.offsets.tolist() == [at, at + 7] and M.payload(raw, video) == DATA[:14]
    assert sound.offsets.tolist() == [at + 14, at + 17, at + 20, at + 23] and M.payload(raw, sound) == DATA[14:26]
