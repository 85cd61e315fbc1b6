"""Op1's statistics and compiled rules, and op8's scores, against plain loops."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import quality as Q
from harborlight.llm import toxicity as X
from harborlight.llm.common import prepare
from harborlight.llm.kernels import utf8

TEXTS = ["Plain words, and more words.", "BUY!!! now | now | now $$$", "", None, "a", "\n\n", "one\none\ntwo", "é è 日本 ß", "12 34 56", "x y z x y z x y z", "  lead and trail  ", "word " * 3000, "Tab\tand\x0bother\x0cspace\r\nline"]


def plain_statistics(text):
    raw = (text or "").encode()
    size, some = len(raw), max(1, len(raw))
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw.lower() if raw.isascii() else bytes(b + 32 if 65 <= b < 91 else b for b in raw)) if w]
    share = lambda codes: sum(b in codes for b in raw) / some
    lines, n = raw.split(b"\n"), len(words)
    spaces = share({9, 10, 11, 12, 13, 32})
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    return {
        "bytes_log": math.log1p(size), "words_log": math.log1p(n), "word_bytes": (1 - spaces) * size / n if n else 0, "upper": share(set(range(65, 91))), "digits": share(set(range(48, 58))),
        "symbols": share(set(b"#$%&*@^_~<>=+{}[]\\/")), "bangs": share(set(b"!")), "bars": share(set(b"|")), "stops": share(set(b".,;:?")), "line_words": n / len(lines), "high_bytes": share(set(range(128, 256))),
        "spaces": spaces, "distinct_words": len(set(words)) / n if n else 0, "top_word": max(words.count(w) for w in set(words)) / n if n else 0,
        "repeated_trigrams": 1 - len(set(triples)) / len(triples) if n > 3 else 0, "repeated_lines": 1 - len(set(lines)) / len(lines) if n else 0,
    }


def test_statistics_by_plain_loops():
    import pyarrow as pa

    got = Q.text_statistics(*utf8(pa.array(TEXTS, pa.string())))
    for row, text in zip(got, TEXTS):
        want = plain_statistics(text)
        assert np.allclose(row, [want[s] for s in Q.STATISTICS]), text and text[:20]


def test_compiled_column_is_the_sum_of_its_rules(spark):
    prepare(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(TEXTS))], "doc_id long, quality int")
    learnt = Q.fit(Q.statistics(docs.join(labels, "doc_id").select("text", F.col("quality").alias("y"), F.lit(1.0).alias("weight")), ["y", "weight"]))
    made = Q.RuleModel(-0.4, (((("upper", True, 0.1),), 1.5), ((("bytes_log", False, 4.0), ("digits", True, 0.2), ("words_log", True, 0.5)), -2.0), ((("spaces", False, 0.2), ("spaces", True, 0.05)), 0.7)))
    for model in (learnt, made):
        for r in Q.statistics(docs, ["doc_id"]).select("doc_id", model.column().alias("score")).collect():
            s = plain_statistics(TEXTS[r.doc_id])
            z = model.bias + sum(w for rule, w in model.rules if all((s[name] > at) if above else (s[name] <= at) for name, above, at in rule))
            assert r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_noisy_or_by_plain_loops(spark):
    prepare(spark)
    model = X.SentenceModel(-3.0, {"bad": 4.0, "^awfu": 3.5, "mild": 0.5, "good": -2.0})
    texts = ["All good here. Fine.", "You are BAD! Awful, awfully bad? Mild.", "bad good. bad\nbad", None, "", "...", "no hit at all", "bad. " * 500, "Ünïcode bad_word 7bad bad"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "bad")], "doc_id long, text string")
    got = {r.doc_id: r for r in X.score(docs, model, offending=0.3).collect()}
    for i, text in [*enumerate(texts), (None, "bad")]:
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            words = set(re.findall(r"[^\W\d_]+", m[0].lower()))
            held = {f for w in words for f in (w, *("^" + w[:n] for n in X.PREFIXES if len(w) >= n)) if f in model.weights}
            p = 1 / (1 + math.exp(-(model.bias + sum(model.weights[f] for f in held))))
            clean *= 1 - p
            if held and p >= 0.3:
                spans.append((m.start(), m.end(), pytest.approx(p)))
        assert got[i].score == pytest.approx(1 - clean, abs=1e-12)
        assert [tuple(s) for s in got[i].sentences] == spans


def test_learning_lowers_the_loss_and_finds_the_words(spark):
    rows = [(f"Some plain text {i}. It says {'vile' if i % 3 == 0 else 'nice'} things. End {i}.", int(i % 3 == 0), 1.0) for i in range(90)]
    model = X.fit(spark.createDataFrame(rows, "text string, y int, weight double"))
    assert model.weights["vile"] > 0 and "nice" not in model.weights

    def loss(m):
        total = 0
        for text, y, _ in rows:
            p = min(max(X.sentence_scores(text, m, {}, 2.0)[0], 1e-12), 1 - 1e-12)
            total -= math.log(p if y else 1 - p)
        return total

    assert loss(model) < 0.2 * loss(X.SentenceModel(-3.0, {}))
    found = X.sentence_scores(rows[0][0], model, {}, 0.3)[1]
    assert [rows[0][0][s["start"] : s["end"]] for s in found] == [" It says vile things"]


@pytest.mark.parametrize("toxic", [1, 2, 3, 5])
def test_few_toxic_labels_still_rank(spark, toxic):
    rows = [(f"A quiet note number {i} on the garden. Nothing else {i % 7}.", 0, 1.0) for i in range(57)]
    rows += [(f"A quiet note on the garden. You vile wretch {'abcde'[i]}. Nothing else.", 1, 1.0) for i in range(toxic)]
    model = X.fit(spark.createDataFrame(rows, "text string, y int, weight double"))
    scores = [X.sentence_scores(t, model, {}, 0.3)[0] for t, _, _ in rows]
    assert model.weights and min(scores[57:]) > max(scores[:57]) and all(0 <= s <= 1 for s in scores)


def test_without_features_the_class_share_is_the_score(spark):
    prepare(spark)
    same = [("the same words", y, 1.0) for y in (0, 0, 0, 1)]
    for rows, share in ((same, 0.25), (same[:3], 0.0), (same[3:], 1.0), ([], 0.0)):
        model = X.fit(spark.createDataFrame(rows, "text string, y int, weight double"))
        docs = spark.createDataFrame([(1, "the same words"), (2, None)], "doc_id long, text string")
        assert [r.score for r in X.score(docs, model).collect()] == [share, share]
        assert not any(r.toxic for r in X.flag(docs, model).collect())


def test_scores_with_clashing_column_names(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "you bad thing", 9.0, 8.0, "x")], "doc_id long, text string, score double, spaces double, sentences string")
    assert X.score(docs, X.SentenceModel(-6.0, {"bad": 9.0})).first().score > 0.9
    made = Q.RuleModel(0.0, (((("spaces", True, 5.0),), 30.0),))
    assert Q.statistics(docs.select("doc_id", "text"), ["doc_id"]).select(made.column().alias("s")).first().s == 0.5
