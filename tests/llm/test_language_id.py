"""Language identification: the forward sums against listing all segmentations, and held-out accuracy."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers

from glossaflow.llm import language_id

from . import edges

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def small_model():
    words = {"x": Counter({"there": 5, "other": 3, "then": 2}), "y": Counter({"der": 4, "andere": 2, "wenn": 3})}
    return language_id.fit(words, PIECES, rounds=2)


def test_forward_sums_all_segmentations():
    model = small_model()
    _, pieces = language_id.vocabulary(PIECES)
    at = {p: i for i, p in enumerate(pieces)}
    for word in ("then", "ndere", "q", "ß中x"):
        marked, want = " " + word, np.zeros(2)
        for k in range(len(marked)):
            for cuts in combinations(range(1, len(marked)), k):
                edges_ = [0, *cuts, len(marked)]
                p = np.ones(2)
                for a, b in zip(edges_, edges_[1:], strict=False):
                    x = model.probabilities[at[marked[a:b]]] if marked[a:b] in at else np.zeros(2)
                    p = p * (np.maximum(x, language_id.FLOOR) if b - a == 1 else x)
                want += p
        assert np.allclose(model.scores([word])[0], np.log(want))


def test_rounds_raise_the_likelihood():
    words = {"x": Counter({"there": 5, "other": 3, "then": 2}), "y": Counter({"der": 4, "andere": 2, "wenn": 3})}
    got = []
    for rounds in (1, 2, 4):
        model = language_id.fit(words, PIECES, rounds, smooth=1e-9)
        got.append(sum(n * model.scores([w])[0][k] for k, lang in enumerate(model.languages) for w, n in words[lang].items()))
    assert got == sorted(got)


def test_long_words_do_not_underflow():
    assert np.isfinite(small_model().scores(["x" * 5000, "中" * 300])).all()


def test_parts_of_long_words_compose():
    model = small_model()
    for word in ("andere" * 7, "otherthen" * 20, "ß中x" * 14 + "wenn", "there" * 16, "thender" * 23):
        marked = " " + word
        n = len(marked)
        want = np.log(model.forward([marked], n)[n][0]) - n * np.log(language_id.SCALE)
        assert np.allclose(model.long_score(marked), want) and np.allclose(model.scores([word])[0], want)
    assert np.isfinite(model.scores(["there" * 20_000])).all()


def test_predictions_are_the_sums_over_words(spark):
    df = edges.documents(spark)
    words = language_id.training_words(df, 20_000, "doc_id", "text", "lang")
    model = language_id.fit(words, PIECES)
    for r in language_id.predict(df, model).join(df.select("doc_id", "text"), "doc_id").collect():
        found = language_id.WORD.findall((r.text or "").lower())
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = sum(model.scores([w])[0] * n for w, n in Counter(found).items())
        assert r.lang_pred == model.languages[int(x.argmax())] and abs(r.score - 1 / np.exp(x - x.max()).sum()) < 1e-6


def test_every_language_has_a_row(spark):
    rows = [(i, f"some words {i} " * 50, "en") for i in range(60)] + [(100 + i, "lange wörter sind hier " * 40_000, "de") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.training_words(df, 10, "doc_id", "text", "lang")
    assert set(got) == {"en", "de"} and all(got.values())


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(df, PIECES).collect()
    truth = {r.doc_id: r.lang for r in df.collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_edges(spark):
    rows = language_id.identify(edges.frame(spark), PIECES).collect()
    by_text = dict(zip([r.doc_id for r in rows], rows, strict=True))
    assert len(rows) == len(edges.rows())
    for doc_id, text, *_ in edges.rows():
        if text is None or not any(c.isalpha() for c in text):
            assert by_text[doc_id].lang_pred == "und" and by_text[doc_id].score == 0 or doc_id is None
    assert language_id.identify(edges.empty(spark), PIECES).count() == 0


def test_a_bounded_sample(spark):
    df = edges.documents(spark)
    some = language_id.training_words(df, 20_000, "doc_id", "text", "lang")
    every = language_id.training_words(df, 10**9, "doc_id", "text", "lang")
    assert set(some) <= set(every) and sum(map(Counter.total, some.values())) < sum(map(Counter.total, every.values()))
