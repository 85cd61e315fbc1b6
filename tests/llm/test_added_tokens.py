"""The registered queries and the pipeline give added tokens their id, as the library does as loaded."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from harborlight.llm import packing, shards, tokens

TEXTS = ["see <|endoftext|> here", "<|endoftext|>", "<|endoftext|><|endoftext|> \n x", "a  <|endoftext|>  b 日本", "<|endoftext |> plain", "no token", "", None]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("added"))
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def want():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    return [library.encode(t or "", add_special_tokens=False).ids + [0] for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_query(spark, docs, want):
    assert want[0] == [3826, 220, 50256, 994, 0]
    for rows in (packing.op10(spark, docs), P.pack(spark, spark.read.parquet(f"{docs}/documents.parquet"), docs)):
        got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows.collect()}
        assert got == {i: (len(x), crc(x)) for i, x in enumerate(want)}


def test_shards_query(spark, docs, want):
    rows = shards.op5(spark, docs).collect()
    assert len(rows) == 1 and rows[0].doc_ids == list(range(len(TEXTS)))
    assert (rows[0].n_tokens, rows[0].ids_crc32) == (sum(map(len, want)), crc(sum(want, [])))
