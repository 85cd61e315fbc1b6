import duckdb
import pytest

import corpus_pipeline as P
from harborlight.llm import entry

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == list(P.COLUMNS), name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0.5 * sizes[0]
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "repeats", "packing"]


def test_stages_on_awkward_rows(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x", None, "s", 1), (None, "y", None, "s", 1), (3, "a b c", "en", "s", 5), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, "a b c"), (4, ""), (None, "x"), (None, "y")], key=str)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = c.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    place = {d[0]: i for i, d in enumerate(want.description)}
    assert columns == sorted(place)
    assert sorted(str([r[k] for k in columns]) for r in got.collect()) == sorted(str([r[place[k]] for k in columns]) for r in want.fetchall())
