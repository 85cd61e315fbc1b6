"""Op6 on short and odd batches against the library."""

import random

import numpy as np
import pytest

from harborlight.llm import sentence_pieces as P
from harborlight.llm.common import prepare
from harborlight.llm.runindex import joined, packed_words, suffix_array


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def fresh():
    return P.Pieces(P.default_model())


def ids(pieces, text):
    known = pieces.remembered(P.strings_of(text))
    return np.frombuffer(b"".join(known[s] for s in P.strings_of(text)), "<u2").tolist()


@pytest.mark.parametrize("n", range(10))
def test_suffix_array_of_few_symbols(n):
    text, _ = joined([b"ab" * n]) if n else (np.zeros(0, np.uint16), None)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(text).tolist() == want and len(packed_words(text)) == len(text) + 512


@pytest.mark.parametrize("text", ["a", "z", "é", "日", " ", "  ", "\n", "▁", "a b", "🙂", "qq", "a" * 5, ""])
def test_one_short_text_is_a_batch(library, text):
    assert ids(fresh(), text) == library.encode(text)


def test_batches_of_one_new_word(library):
    pieces = fresh()
    for text in ("hello world", "z", "hello", "hello q", "ü", "world z"):
        assert ids(pieces, text) == library.encode(text)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(library, seed):
    rnd = random.Random(seed)
    pieces, alphabet = fresh(), "abcdeéßñ 日本語中 \n\t.,_-🙂thing ation  ▁"
    for _ in range(150):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice((1, 2, 3, 8, 40, 200, 900))))
        assert ids(pieces, text) == library.encode(text)


def test_long_strings_take_the_same_edges(library):
    for text in ("https://example.org/" + "segment/" * 300 + "?q=" + "x" * 500, "日本語の文章です" * 400, "internationalization" * 90, "aaaa" * 700):
        assert ids(fresh(), text) == library.encode(text)


def test_memory_is_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 5000)
    pieces, most = fresh(), 0
    for i in range(40):
        text = f"{'w' * 900}{i} short{i}"
        assert ids(pieces, text) == library.encode(text)
        most = max(most, pieces.held)
    assert most < 5000 + 4000


def test_tables_of_one_letter(spark, library):
    prepare(spark)
    rows = [(1, "a"), (2, None), (None, "b"), (3, ""), (1, "a")]
    for some in (rows[:1], rows):
        got = P.encode(spark.createDataFrame([(i, t, "x") for i, t in some], "doc_id long, text string, ids string").repartition(5), P.default_model()).collect()
        assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u2").tolist()) for r in got) == sorted((i or 0, library.encode(t or "")) for i, t in some)
