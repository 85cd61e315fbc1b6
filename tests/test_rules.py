"""Rule operators with the domain's own words, readers, sinks and streams."""

import json
import math
import random
import re
import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harborlight.operators import curation, retrieval
from harborlight.functions import chunks
from harborlight.functions import text as T
from harborlight.operators import alerts
from harborlight.plans import catalogue, dialogue, screening
from harborlight.plans.corpus import transitions
from harborlight.plans.events import histogram_quantiles
from harborlight.plans.screening import latest_records, page, roster_problems
from harborlight.sources import readers, sinks
from harborlight.streaming.limiter import admitted, admitted_stream, decide
from harborlight.streaming.topics import run_once
from harborlight.streaming.windows import rolling, rolling_stream


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


WORDS, NO = ("想死", "自杀", "轻生"), ("没有", "不想", "不会", "不", "没", "别")


@pytest.mark.parametrize("text,words", [("我想死", ["想死"]), ("我不想死", []), ("一点都不想死", []), ("没有自杀", []), ("不 自杀", []), ("不想死,但想轻生", ["轻生"]), ("", []), (None, []), ("我不好,想死", ["想死"])])
def test_signal_words(spark, text, words):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(T.signal_words(F.col("t"), WORDS, NO, "一点都也很太真")).first()[0] == words


def test_shingles_of_short_texts(spark):
    rows = spark.createDataFrame([("abcde",), ("ab",), ("",)], "t string").select(T.shingles(F.col("t"), 4)).collect()
    assert [r[0] for r in rows] == [["abcd", "bcde"], ["ab"], []]


def test_clean_lines(spark):
    rows = spark.createDataFrame([("﻿ a \n\n\n\n b\t\tc \r\n",)], "t string")
    assert rows.select(T.clean_lines(F.col("t"))).first()[0] == "a\n\nb c"


def test_chunks(spark):
    text = "# Head\n\n" + "a" * 45 + "\n\n" + "short.\n\n" + "b" * 25 + "\n \n" + "c" * 30 + "\n\n" + "d" * 900
    more = "front matter of some length\n\n## One\n\nbody of the first section\n\n### Two\n\n" + "e. " * 200 + "\n\n#no header, but text"
    rows = [(1, text), (2, None), (3, "tiny"), (4, more)]
    got = {}
    for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.posexplode(chunks.chunks(F.col("text"))).alias("n", "c")).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.c)
    assert got[1] == ["[Head] " + "a" * 45, "[Head] " + "b" * 25 + "\n" + "c" * 30, "[Head] " + "d" * 400, "[Head] " + "d" * 400, "[Head] " + "d" * 100]
    assert set(got) == {1, 4} and got[4][:2] == ["front matter of some length", "[One] body of the first section"]
    assert all(c.startswith("[Two] ") for c in got[4][2:]) and all(len(c) <= 406 for c in got[4]) and got[4][-1] == "[Two] #no header, but text"
    c = duckdb.connect()
    want = c.execute(f"SELECT {chunks.chunks_sql('t')} FROM (SELECT unnest(?) AS t, unnest(range({len(rows)})) AS i) ORDER BY i", [[t for _, t in rows]]).fetchall()
    assert [w[0] for w in want] == [got.get(i, []) for i, _ in rows]


def test_chunks_of_long_texts_cost_their_length():
    """10 MB of short blocks and 10 MB without a blank line are both a pass."""
    block, began = "a line of some length. ", time.time()
    many = chunks.chunks_of("# T\n\n" + (block + "\n\n") * 400_000)
    one = chunks.chunks_of(block * 400_000 + "x" * 1_000_100)
    assert len(many) == 200_000 and all(len(c) <= 404 for c in many) and "".join(one) == block * 400_000 + "x" * 1_000_100
    assert time.time() - began < 30


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("source: x\n" + "first part that is long enough to be a chunk of its own\n\n" + "second part that is long enough to be another chunk\n")
    (tmp_path / "b.md").write_text("## 来源：y\n# T\n\nthe only part of this file")
    (tmp_path / "c.csv").write_text("no")
    got = sorted((r.id, r.source, r.tag, r.text) for r in readers.corpus_folder(spark, str(tmp_path)).collect())
    assert [g[:3] for g in got] == [("a.txt#0", "a.txt", "source: x"), ("a.txt#1", "a.txt", "source: x"), ("b.md#0", "b.md", "## 来源：y")]
    assert got[2][3] == "[T] the only part of this file"


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_nearest_against_all_pairs(spark, slice_rows):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 8)).astype(np.float32)
    x[10] = x[20] = x[30]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(99, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.nearest(asked, vectors, 5, slice_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    for q in (0, 20, 40):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(60))[:5]
        assert got[q] == [(i, round(v, 9)) for v, i in want]
    assert retrieval.nearest(asked, vectors.limit(0), 5).count() == 0


def test_bm25_against_plain_loops(spark):
    texts = ["a b c", "a a d", "b d e f", "x", None, "c c c a"]
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "A c zz"), (2, "e"), (3, "")], "query_id long, text string")
    words = [(t or "").split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    want = {}
    for q, terms in ((1, ["a", "c", "zz"]), (2, ["e"])):
        for i, w in enumerate(words):
            score = 0
            for t in terms:
                df = sum(t in x for x in words)
                idf = max(0, math.log((len(words) - df + 0.5) / (df + 0.5)))
                score += idf * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean))
            if score > 0:
                want[q, i] = round(score, 9)
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in retrieval.bm25(asked, docs).collect()} == want


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, False), (1, 11, 0.6, True), (1, 12, 0.7, True)], "query_id long, id long, distance double, boosted boolean")
    strong = spark.createDataFrame([(1, 11), (1, 13)], "query_id long, id long")
    got = {r.id: (round(r.distance, 6), r.origin) for r in retrieval.fuse(hits, strong, 1.2).collect()}
    assert got == {10: (0.5, "vector"), 11: (0.52, "both"), 12: (0.65, "vector"), 13: (1.17, "lexical")}


def test_chunks_take_small_batches(spark):
    """Workers get 1000 texts or 8 MB at once at most, however many a partition has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = [None if i % 50 == 0 else f"# T{i}\n\n" + f"text number {i} has a sentence. " * (i % 30) for i in range(2500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    got = {r.i: r.c for r in rows.select("i", chunks.chunks(F.col("text")).alias("c")).collect()}
    assert got == {i: chunks.chunks_of(t) for i, t in enumerate(texts)}
    seen = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").distinct().collect()]
    assert max(seen) <= 1000


@pytest.mark.parametrize("name", ["RET01_chunks", "RET02_long_splitter", "SRC03_corpus", "SRC09_chunk_scan"])
def test_chunks_take_small_batches_in_any_session(spark, name):
    """The session that a query is given need not be the active one."""
    own, key = spark.newSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert int(own.conf.get(key)) > 1000
    catalogue.queries()[name](own, "/root/testdata/sf0.001")
    assert (own.conf.get(key), own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == ("1000", "8m")


@pytest.mark.parametrize("name", ["RET01_chunks", "SRC03_corpus", "SRC09_chunk_scan"])
def test_texts_are_cut_once(spark, name, capsys):
    """One step of the plan calls Python, so a task has one worker."""
    catalogue.queries()[name](spark, "/root/testdata/sf0.001").explain()
    assert len(re.findall("ArrowEvalPython ", capsys.readouterr().out)) == 1


def test_run_transitions(spark):
    old = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False), (5, True)], "doc_id long, p boolean")
    new = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (6, True)], "doc_id long, p boolean")
    assert {r.change: r.n for r in transitions(old, new).collect()} == {"both_pass": 1, "fixed": 1, "regressed": 1, "both_fail": 1}


def test_minhash_and_bands(spark):
    texts = ["the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again!", "wholly different words stand in this line of text", "ab"]
    rows = curation.minhash(spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "id long, text string"))
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {0, 1, 2, 3}
    for i, t in enumerate(texts):
        grams = {t[k : k + 4] for k in range(max(1, len(t) - 3))}
        assert got[i].n == len(grams) == len(got[i].grams)
        numbers = [sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) for g in grams]
        want = [min((a * h + b) % (2**61 - 1) for h in numbers) for a, b in zip(*(d.tolist() for d in curation.DRAW))]
        assert got[i].signature == want
    assert [tuple(r) for r in curation.band_candidates(rows).collect()] == [(1, 0)]


def test_near_duplicates_of_large_families(spark):
    rnd = random.Random(6)
    words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{i % 10}" for i in range(300)]
    base, texts = [rnd.choice(words) for _ in range(60)], []
    for _ in range(80):
        own = list(base)
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(60)] = rnd.choice(words)
        texts.append(" ".join(own))
    got = {r.id for r in curation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    assert got == {j for j in range(80) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}


@pytest.mark.parametrize("likely,block", [(curation.LIKELY, 1024), (0.0, 16), (curation.LIKELY, 8)])
def test_near_duplicates_in_split_bands(spark, likely, block):
    """One band that all rows share, in blocks; families at the limit, far rows, and short texts."""
    rnd = random.Random(11)
    texts = []
    for f in range(6):
        base = [rnd.choice("abcdefgh") for _ in range(120)]
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(120)] = rnd.choice("xyz")
            texts.append("".join(own))
    texts += ["ab", "ab", "abc", ""]
    rnd.shuffle(texts)
    got = {r.id for r in curation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), likely=likely, block=block).collect()}
    sets = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set() for t in texts]
    assert got == {j for j in range(len(texts)) if sets[j] and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}


def test_open_rows_in_tiles_move_no_set_twice_a_pair(spark, tmp_path, monkeypatch):
    """A dense family just below the limit: its pairs are decided inside tasks, and no table holds them."""
    rnd = random.Random(3)
    base, texts = [rnd.choice("abcdefgh") for _ in range(300)], []
    for _ in range(150):
        own = list(base)
        for k in rnd.sample(range(300), 7):
            own[k] = rnd.choice("xyz")
        texts.append("".join(own))
    texts += [texts[70][:-2] + "pq", texts[20]]
    sizes = {}

    def counted(df, name, *a):
        out = written(df, name, *a)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    from harborlight.sources.folders import written

    monkeypatch.setattr(curation, "written", counted)
    got = {r.id for r in curation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    assert got == {j for j in range(len(texts)) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}
    assert max(sizes.values()) <= len(texts), sizes


@pytest.mark.parametrize("tile", [5, 1000])
def test_tiles_decide_exactly(spark, tile):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(20, 60))) for _ in range(12)]
    texts = [(t[:k] + "z" + t[k:]) * (1 + f % 2) for f in range(4) for k, t in enumerate(texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    docs = curation.sketches(curation.signatures(rows)).select("id", "n", "low", (F.col("id") % 3 != 0).alias("ask"))
    got = {r.j for r in curation.near_in_tiles(docs, len(texts), rows, 0.8, 4, 0.0, tile).collect()}
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    assert got == {j for j in range(len(texts)) if j % 3 and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}


def test_split_bands_propose_what_whole_bands_do(spark):
    rows = curation.minhash(spark.createDataFrame([(i, "common words " * 3 + f"row {i % 7} {'x' * (i % 5)}") for i in range(60)], "id long, text string"))
    banded = curation.bands(rows).withColumn("members", F.lit(60)).withColumn("ask", F.col("id") % 2 == 0)
    whole, split = (sorted(map(tuple, curation.witnesses(banded, 0.8, True, 0.5, block).collect())) for block in (1000, 7))
    assert whole and whole == split and all(i < j and j % 2 == 0 for i, j in whole)


def test_near_duplicates_against_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest"
    texts = [base, base + "!", base.replace("quick", "slow"), "something else entirely, not alike at all", base, "", None, "ab", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id for r in curation.near_duplicates(rows).collect()}
    sets = [set() if not t else {t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in texts]
    want = {j for j in range(len(texts)) if sets[j] and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}
    assert got == want


def test_limiter_keeps_admitted_requests_only(spark):
    assert decide([0, 10, 20, 30, 61, 62, 75], [], 3, 60)[0] == [True, True, True, False, True, False, True]
    rows = spark.createDataFrame([("a", at(t), t) for t in (0, 10, 20, 30, 61, 62, 75)] + [(None, at(5), 99)], "key string, ts timestamp, event_id long")
    got = {r.event_id: r.admitted for r in admitted(rows, 3, 60).collect()}
    assert got == {0: True, 10: True, 20: True, 30: False, 61: True, 62: False, 75: True, 99: True}


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 3}", at(i * 7), i) for i in range(60)], "key string, ts timestamp, event_id long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = admitted_stream(stream, 2, 60, forget=False).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limited").collect()} == {tuple(r) for r in admitted(rows, 2, 60).collect()}


def test_topic_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "a"), (datetime(2024, 1, 7, 23), "a"), (datetime(2024, 1, 8), "a")], "ts timestamp, topic string")
    rows.write.parquet(f"{tmp_path}/in")
    got = run_once(spark, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).orderBy("week").collect()
    assert [(str(r.week)[:10], r.n) for r in got] == [("2024-01-01", 2), ("2024-01-08", 1)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿学号,姓名,班级\n 1 , Li ,\n2,,b\n", encoding="utf-8")
    rows = readers.roster_csv(spark, str(tmp_path / "r.csv")).orderBy("student_no").collect()
    assert [tuple(r) for r in rows] == [("1", "Li", None, None), ("2", None, None, "b")]
    log = [json.dumps({"ts": "2024-01-02T00:00:00", "caller": "case", "query": "x"}), "{broken", "", json.dumps({"caller": "case"}), json.dumps({"ts": "2024-01-02T00:00:00", "caller": "other"})]
    (tmp_path / "log.jsonl").write_text("\n".join(log))
    good, bad = readers.event_log(spark, str(tmp_path / "log.jsonl"), since="2024-01-01")
    assert (good.count(), bad.count()) == (1, 2)
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("hello")
    assert [tuple(r) for r in readers.text_folder(spark, str(tmp_path / "kb")).collect()] == [("a.md", "hello")]
    sinks.write_report_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8").startswith("﻿a,b")
    sinks.write_daily_json(spark.createDataFrame([(datetime(2024, 1, 2), 1)], "ts timestamp, v int"), str(tmp_path / "days"))
    assert (tmp_path / "days" / "day=2024-01-02").exists()
    write = sinks.dual_sink(str(tmp_path / "j"), str(tmp_path / "t"))
    for _ in range(2):
        write(spark.createDataFrame([(1,)], "v int"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        readers.roster(spark.createDataFrame([(1,)], "x int"))


def test_latest_record_falls_back_to_the_account(spark):
    own = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 8), (5, None)], "session_id long, account_id long")
    rows = spark.createDataFrame([(1, at(0), 1), (1, at(9), 2), (3, at(5), 1), (2, at(3), 4)], "session_id long, created_at timestamp, record_no long").where("session_id <> 2")
    got = {r.session_id: (r.record_session, r.record_no) for r in latest_records(own, rows).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (None, None), 5: (None, None)}


def test_page_and_cursor(spark):
    rows = spark.createDataFrame([(i, at(i // 2)) for i in range(130)], "session_id long, created_at timestamp")
    for asked, anonymous, size in ((0, False, 1), (30, False, 30), (400, False, 100), (400, True, 50)):
        got = page(rows, asked, anonymous).collect()
        assert sorted((r.session_id for r in got), reverse=True) == list(range(129, 129 - size, -1)) and {r.next_cursor for r in got} == {at((130 - size) // 2)}
    assert {r.next_cursor for r in page(rows.where("session_id < 5"), 5, False).collect()} == {None}


def test_roster_problems(spark):
    rows = [(i, 1, i, " " if i % 2 else "x") for i in range(40)] + [(100, 2, 5, "a"), (101, 2, 5, "a"), (102, 2, 5, "a"), (103, 2, 6, "a"), (104, 2, 6, None)] + [(1000 + i, 3, i, "x") for i in range(501)]
    got = sorted(map(tuple, roster_problems(spark.createDataFrame(rows, "student_no long, batch_id long, code long, name string")).collect()), key=str)
    assert got == sorted([(1, i, "blank") for i in range(1, 20, 2)] + [(2, 104, "blank"), (2, 101, "duplicate"), (3, None, "too many rows")], key=str)


def test_codes_are_unique(spark, monkeypatch):
    monkeypatch.setattr(screening, "_CODE", "AB" * 16)  # 64 codes only
    got = [r.code for r in screening.unique_codes(spark.range(50).withColumnRenamed("id", "student_no")).collect()]
    assert len(got) == 50 and len(set(got)) >= 49


def test_rolling_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(c, t, f"{c}:{t}") for c in range(3) for t in range(4 + 5 * c)], "conv_id long, turn long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = rolling_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 4, 2).writeStream.format("memory").queryName("rolled").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("rolled")
    assert {tuple(r) for r in got.drop("left").collect()} == {tuple(r) for r in rolling(rows, 4, 2).collect()}
    assert [x for r in got.where("conv_id = 2").orderBy("turn").collect() for x in r.left] == [f"2:{t}" for t in range(10)]


def test_alerts(spark):
    times = [3600 * h + 10 for h in (0, 1, 2, 3, 4, 5, 9, 10)]
    rows = spark.createDataFrame([(at(t), True) for t in times] + [(at(3600 * 2 + 20), False)], "ts timestamp, bad boolean")
    every = alerts.evaluations(rows, 7200, 3600, bad=F.count_if("bad"), n=F.count(F.lit(1)))
    base = int(datetime(2024, 1, 1).timestamp()) // 3600
    assert {r.k - base: (r.bad, r.n) for r in every.collect()} == {1: (1, 1), 2: (2, 2), 3: (2, 3), 4: (2, 3), 5: (2, 2), 6: (2, 2), 7: (1, 1), 10: (1, 1), 11: (2, 2), 12: (1, 1)}
    assert {r.k - base: r.bad for r in alerts.gap_filled(every, "bad").where("bad = 0").collect()} == {8: 0, 9: 0}
    got = [tuple(r) for r in alerts.held(every.where("bad = n"), 3600, 7200).orderBy("start").collect()]
    assert got == [(at(3600 * 5), at(3600 * 7), at(3600 * 7)), (at(3600 * 10), at(3600 * 12), at(3600 * 12))]


def test_histogram_quantiles(spark):
    rows = spark.createDataFrame([("a", v) for v in (0.5, 1.5, 1.5, 4.0)] + [("b", 99.0)], "k string, value double")
    got = {(r.k, r.q): r.value for r in histogram_quantiles(rows, (0.5, 0.95), "k").collect()}
    assert got == {("a", 0.5): 1.5, ("a", 0.95): 4.4, ("b", 0.5): 50.0, ("b", 0.95): 50.0}


@pytest.mark.parametrize("replies,want", [
    (["x hello to the whole y", "the whole world now!", "say hello to the whole world now"], [None, None, " hello to the whole "]),
    (["short", "short"], [None, None]), (["", ""], [None, None]), (["exactly12chr", "exactly12chr"], [None, "exactly12chr"]),
    (["abcabcabcabcabcabc", "zabcabcabcabcabcabcabc"], [None, "abcabcabcabcabcabc"]), (["aaaaaaaaaaaaaaaa", "bbbbbbbbbbbbbb", "aaaaaaaaaaaaabbbbbbbbbbbbbb"], [None, None, "bbbbbbbbbbbbbb"]),
])
def test_longest_overlap(spark, replies, want):
    rows = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(replies)] + [(2, 0, "assistant", replies[-1]), (1, 90, "user", replies[-1])], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.overlap for r in dialogue.overlaps(rows).where("conv_id = 1").collect()}
    assert [got.get(i) for i in range(len(replies))] == want
    assert {r.turn for r in dialogue.repeated(rows).where("conv_id = 1").collect()} == {i for i, w in enumerate(want) if w}


def test_sample_lines(spark):
    good = '[{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]'
    lines = [good, good[:-1], "", None, "[]", good.replace("gpt", "bot"), good.replace('"b"', '" "'), '[{"from": "human", "value": "a"}]', good.replace('"b"', "null")]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    assert [r.id for r in readers.valid_samples(rows, "line").collect()] == [0]


def test_masks_and_keys(spark):
    rows = spark.createDataFrame([("王小明老师电话13800138000，李老师好",), ("《书名》 A-b！1",)], "t string")
    got = [tuple(r) for r in rows.select(T.masked(F.col("t"), ("王", "李"), ("老师", "同学")), T.key_latin_han(F.col("t")), T.without_titles(F.col("t"))).collect()]
    assert got[0][0] == "<name>电话<number>，李老师好" and got[1][1:] == ("书名ab1", "A-b！1")


def test_aligned_outputs_and_namespaces(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 50), (3, "c", None, None)], "id long, text string, origin string, n long")
    sinks.write_aligned(rows, str(tmp_path / "out"), ["text"], ["origin"], "n < 10")
    ids = {k: sorted(r.id for r in spark.read.schema("id long").json(f"{tmp_path}/out/{k}").collect()) for k in ("samples", "provenance", "rejected")}
    assert ids == {"samples": [2, 3], "provenance": [2, 3], "rejected": [1]}
    sinks.reset_namespace(spark.createDataFrame([("a", 1), ("b", 1)], "namespace string, v int"), str(tmp_path / "ns"))
    sinks.reset_namespace(spark.createDataFrame([("b", 2), ("c", 2)], "namespace string, v int"), str(tmp_path / "ns"))
    assert sorted((r.namespace, r.v) for r in spark.read.parquet(str(tmp_path / "ns")).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_daily_json_stream_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([(at(0), 1), (at(90000), 2)], "ts timestamp, v int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        sinks.stream_daily_json(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.json(f"{tmp_path}/out").count() == 2 and (tmp_path / "out" / "day=2024-01-02").exists()


def test_band_candidates_hash_texts_once(spark):
    rows = spark.createDataFrame([(i, f"text number {i % 9} of some length") for i in range(30)], "id long, text string")
    found = curation.band_candidates(curation.signatures(rows))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert {r.id for r in found.collect()} >= set(range(9, 30))
