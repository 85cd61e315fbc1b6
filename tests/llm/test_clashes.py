"""Extra columns whose names the operators use themselves, and very long texts, in every stage."""

import corpus_pipeline as P
from harborlight.llm import exact_dedup, jaccard_join, packing, repeats, shards, toxicity
from harborlight.llm.common import prepare

NAMES = ("own", "row", "digest", "marks", "maybe", "toxic", "key", "node", "salt", "part", "n", "tile", "locator", "heavy", "ids", "held", "start")
PASSAGE = " ".join(f"passage{i}" for i in range(40))
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60000))
ROWS = [(1, PASSAGE + " one"), (2, "two " + PASSAGE), (3, LONG), (4, LONG + " tail"), (5, None), (6, ""), (1, "other text under one id"), (None, PASSAGE)]


def table(spark):
    prepare(spark)
    more = ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *NAMES) for i, t in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {more}")


def test_clashing_names_change_nothing(spark):
    docs = table(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, repeats.without_repeats(plain).collect()))
    assert all(r[n] == n for r in out.collect() for n in NAMES)
    for f in (exact_dedup.exact_dedup, jaccard_join.jaccard_groups, repeats.remove_repeats, packing.pack):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect())), f
    assert shards.read_slots(shards.materialise(docs)).count() == shards.read_slots(shards.materialise(plain)).count()
    model = toxicity.SentenceModel(-6.0, {"bad": 9.0})
    assert toxicity.flag(docs, model).columns == [c for c in docs.columns if c != "toxic"] + ["toxic"]


def test_stages_with_clashing_names_and_long_texts(spark):
    docs = table(spark)
    for name, stage in P.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.columns == list(P.COLUMNS), name
            kept = {r.doc_id for r in out.collect()}
            assert {5, 6} & kept and (3 in kept or 4 in kept), name
