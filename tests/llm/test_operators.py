"""Each corpus operator against a brute-force version, on awkward rows: nulls, empty and long
texts, ties, repeated rows, no rows at all, and extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import exact_dedup, jaccard_join, licences, media, packing, quality, repeats, sentence_pieces, shards, tokens, toxicity
from harborlight.llm.common import prepare, without
from harborlight.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, marks string, kept string"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, "m", "k") for i, t in rows], SCHEMA)


def words(seed, n, vocabulary=300):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY[:vocabulary]) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdefgé") for _ in range(2 + i % 6)) for i in range(400)]
LONG = words(1, 3000)
NEAR = LONG.split(" ")
ROWS = [
    (3, LONG), (7, " ".join(NEAR[:1500] + ["Other"] + NEAR[1501:])), (5, "one two three"), (6, "One TWO three"), (1, None), (2, ""), (4, "  \n\t "),
    (9, words(2, 80)), (10, words(2, 80)), (11, words(2, 80)), (11, words(2, 80)), (20, LONG[:4000]), (21, "prefix " + LONG[300:900] + " suffix"), (None, words(2, 80)), (30, "a" * 700), (31, "<|endoftext|> 🙂 日本"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_exact_dedup(awkward):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(awkward).collect()), key=str)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in ROWS:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_splits_collisions(awkward):
    plain = sorted(map(str, exact_dedup.exact_dedup(awkward).collect()))
    weak = sorted(map(str, exact_dedup.exact_dedup(awkward, digest=F.length("text") % 3).collect()))
    assert plain == weak


def test_exact_dedup_continues_its_state(spark, tmp_path):
    state = exact_dedup.DigestState(spark, f"{tmp_path}/s")
    schema = "digest string, doc_id long, locator string, text_sha256 string"
    for rows in ([("a", 1, "x", "d"), ("b", 5, "y", "e")], [("a", 4, "z", "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state.absorb(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, state.groups().collect())) == [("a", 4, "z", "d", 2), ("b", 5, "y", "e", 1)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_groups(awkward):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(awkward).collect()), key=str)
    sets = [shingles(t) for _, t in ROWS]
    label = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and sets[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    name = {c: min((ROWS[k][0] for k in range(len(ROWS)) if label[k] == c and ROWS[k][0] is not None), default=None) for c in label}
    assert got == sorted(((i, len(sets[k]), name[label[k]]) for k, (i, _) in enumerate(ROWS)), key=str)


def test_jaccard_groups_with_many_near_copies(spark):
    rnd = random.Random(5)
    base, rows = [words(7, 120).split(" "), words(8, 120).split(" ")], []
    for i in range(90):
        w = list(base[i % 2])
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
        rows.append((i, " ".join(w[rnd.randint(0, 4) :])))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(table(spark, rows)).collect()}
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == {i: min(k for k in range(len(rows)) if label[k] == label[i]) for i in range(len(rows))}


def test_bitmaps_bound_from_above():
    rnd = np.random.default_rng(3)
    for na, nb, both in ((30, 40, 20), (400, 500, 390), (3000, 2800, 10), (5, 5, 5)):
        pool = rnd.integers(1, 1 << 62, na + nb - both, dtype=np.uint64)
        a, b = np.sort(pool[:na]), np.sort(pool[na - both :])
        bound = jaccard_join.Bitmaps([jaccard_join.bitmap(a), jaccard_join.bitmap(b)]).most_overlap(np.array([na, nb]), np.array([0]), np.array([1]))[0]
        assert both <= bound <= min(na, nb)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert len(got) == 44 and len({got[i] for i in range(41)}) == 1 and len(set(got.values())) == 2


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), kept)
    return out


def test_repeats(awkward):
    unique = {i: t for i, t in ROWS if i is not None}
    want = removed(unique.items(), 100)
    for r in repeats.remove_repeats(awkward).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
            assert r.kept_sha256 == hashlib.sha256(r.kept).hexdigest()


def test_repeats_in_small_blocks(spark):
    rnd = random.Random(2)
    passage = words(3, 60)
    rows = [(i, words(50 + i, 20) + passage[rnd.randint(0, 30) : 200 + rnd.randint(0, 90)] + words(90 + i, 20)) for i in range(40)]
    docs = table(spark, rows).select("doc_id", "text")
    found = repeats.fold(repeats.entries(docs, 100, 4))
    asked = repeats.texts_of(docs, found.where("anchor is not null"), 100)
    small = repeats.compare(asked, 100, block=2000)
    whole = repeats.compare(asked, 100)

    def cover(marks):
        return {(r.doc_id, p) for r in marks.collect() for p in range(r.start, r.start + r.windows)}

    assert cover(small) == cover(whole) and cover(whole)
    want = removed(rows, 100)
    assert all(r.n_removed == want[r.doc_id][1] for r in repeats.remove_repeats(docs).collect())


def test_repeats_with_two_texts_under_one_id(spark):
    out = repeats.remove_repeats(table(spark, [(1, LONG[:300]), (1, LONG[500:900]), (2, LONG[:300])])).collect()
    # the copy under the other doc_id goes whole, whichever text of doc_id 1 is first
    assert len(out) == 3 and sorted(r.n_removed for r in out) == [0, 0, len(LONG[:300].encode())]


def test_repeats_keep_other_columns(awkward):
    out = repeats.without_repeats(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == len(ROWS)
    assert out.where("doc_id = 1").first().text is None


def test_packing(awkward):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    rows = packing.pack(awkward, length=64).collect()
    ids = {}
    for i, text in ROWS:
        ids.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [0])
    total = sum(len(x) for g in ids.values() for x in g)
    assert sum(r.length for r in rows) == total
    stream = {}
    for r in rows:
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens][0]
        part = own[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
        stream.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in stream.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(stream)
    assert sorted(stream) == list(range(-(-total // 64)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):
    x = np.arange(size)
    y = shards.feistel(x, size)
    assert sorted(y.tolist()) == x.tolist()
    assert shards.feistel(y, size, inverse=True).tolist() == x.tolist()
    assert size < 64 or shards.feistel(x, size, key=5).tolist() != y.tolist()


def test_shards_hold_every_sequence(spark, awkward):
    written = shards.materialise(awkward, length=32)
    rows = shards.read_slots(written).orderBy("slot").collect()
    pieces = packing.pack(awkward, length=32).collect()
    n = max(p.sequence_id for p in pieces) + 1
    assert [r.slot for r in rows] == list(range(n)) and sorted(r.sequence_id for r in rows) == list(range(n))
    assert sum(r.n_tokens for r in rows) == sum(p.length for p in pieces)
    assert all(shards.feistel(np.array([r.sequence_id]), n)[0] == r.slot for r in rows)
    assert shards.read_slots(written, first=n - 3).count() == 3


@pytest.mark.parametrize("per_shard", [1, 7, 600])
def test_shards_resume_at_any_slot(awkward, per_shard):
    written = shards.materialise(awkward, length=16, per_shard=per_shard)
    n = shards.read_slots(written).count()
    assert n > 700
    for first in (0, 1, 599, 600, 601, n - 1, n):
        assert sorted(r.slot for r in shards.read_slots(written, first).select("slot").collect()) == list(range(first, n))
    for s in written.collect():
        assert s.first_slot == s.shard * per_shard and len(s.payload) == s.stride * len(s.records)
        assert [r.slot for r in s.records] == list(range(s.first_slot, s.first_slot + len(s.records)))


def test_sentence_pieces_equal_the_library(awkward):
    import sentencepiece

    model = sentence_pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in sentence_pieces.encode(awkward, model).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == library.encode(r.text)
    assert all(r.lossless for r in sentence_pieces.round_trip(sentence_pieces.encode(awkward, model), model).collect())


def test_media_round_trip(awkward):
    for r, (i, t) in zip(media.store(awkward).collect(), ROWS):
        raw = (t or "").encode()
        track = media.tracks(bytes(r.media))[0]
        data = media.payload(bytes(r.media), track)
        assert data.rstrip(b" ") == raw.rstrip(b" ") and len(data) % 192 == 0 and data.startswith(raw) and r.n_bytes == len(raw)
        assert [data[k * 192 : (k + 1) * 192] == bytes(r.media)[a : a + n] for k, (a, n) in zip(track.keys, track.ranges())].count(False) == 0
    probed = media.probe(media.store(awkward)).collect()
    assert all(p.error is None and [(t.codec, len(t.keyframes)) for t in p.tracks] == [("raw ", -(-p.tracks[0].samples // 12))] for p in probed)
    back = {(r.doc_id, r.payload_bytes): r for r in media.read_back(media.store(awkward)).collect()}
    for i, t in ROWS:
        data = (t or "").encode()
        data = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        r, stored = back[i, len(data)], media.encode((t or "").encode())
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.codec, r.duration) == ("raw ", len(data) / 192 / 48)
        assert [data[k * 192 * 12 : k * 192 * 12 + 192] for k in range(len(r.keyframes))] == [stored[x.offset : x.offset + x.size] for x in r.keyframes]


def test_media_reports_damaged_files(spark):
    good = media.encode(b"x" * 1000)
    rows = spark.createDataFrame([(1, bytearray(good[:-9])), (2, bytearray(b"")), (3, None), (4, bytearray(b"junk" * 9)), (5, bytearray(good))], "doc_id long, media binary")
    got = {r.doc_id: r.error for r in media.probe(rows).collect()}
    assert all(got[i] for i in (1, 2, 3, 4)) and got[5] is None


def test_licences(spark):
    line = "Released under the MIT License."
    rows = [("a/LICENSE", f"{line}\nmore"), ("a/b/x.py", "code"), ("a/b/c/y.py", None), ("d/z.py", f"code\n{line}"), ("d/w.py", ""), (None, "code"), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/n.py", "no licence of any kind is meant in this copyright example of words")]
    files = spark.createDataFrame(rows, "path string, text string")
    scanned = licences.scan(files)
    got = {r.path: (r.licence, r.origin) for r in licences.inherit(scanned, F.col("path").endswith("LICENSE")).collect()}
    assert got == {"a/LICENSE": ("MIT", "own"), "a/b/x.py": ("MIT", "directory"), "a/b/c/y.py": ("Apache-2.0", "directory"), "d/z.py": ("MIT", "own"), "d/w.py": (None, "none"), None: (None, "none"), "a/b/c/LICENSE": ("Apache-2.0", "own"), "a/n.py": ("MIT", "directory")}


def test_classifiers_on_held_out_rows(spark):
    prepare(spark)
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    from harborlight.llm import entry

    for name, column, least in (("op1_quality", "quality", 0.93), ("op8_toxicity", "toxic", 0.9)):
        got = entry.queries()[name](spark, d).toPandas()
        assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
        held = got[got["held_out"]].merge(labels, on="doc_id")
        assert (held["predicted"] == held[column]).mean() >= least


def test_classifiers_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for docs in (awkward, empty):
        model = toxicity.learn(docs, labels)
        assert toxicity.score(docs, model).count() == docs.count() and toxicity.flag(docs, model).columns[-1] == "toxic"
        rules = quality.learn(docs, labels)
        rows = quality.statistics(docs.select("doc_id", "text"), ["doc_id"]).select(rules.column().alias("s")).collect()
        assert len(rows) == docs.count() and all(0 <= r.s <= 1 for r in rows)


def test_toxic_sentences_are_located():
    model = toxicity.SentenceModel(-6.0, {"bad": 9.0})
    score, spans = toxicity.sentence_scores("All fine. You are BAD! Fine.", model, {}, 0.3)
    assert score > 0.9 and [(s["start"], s["end"]) for s in spans] == [(9, 21)]


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert jaccard_join.jaccard_groups(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert shards.read_slots(shards.materialise(empty)).count() == 0
    assert media.read_back(media.store(empty)).count() == 0
    model = sentence_pieces.default_model()
    assert sentence_pieces.round_trip(sentence_pieces.encode(empty, model), model).count() == 0
    assert licences.inherit(licences.scan(empty.withColumn("path", F.col("source"))), F.lit(True)).count() == 0


def test_without(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, None)], "doc_id long")
    assert sorted((r.doc_id for r in without(rows, rows.where("doc_id = 2"), "doc_id").collect()), key=str) == [1, 3, None]
