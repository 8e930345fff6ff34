"""Mixing: raked margins, calibrated probabilities, and samples that come out near them."""

from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from tokenizers import Tokenizer

from glossaflow.llm import mixing, queries
from glossaflow.llm.mixing import Margin

from . import edges

TOPICS = {"a": ["alpha", "One"], "b": ["beta"]}


def test_raking_meets_every_margin():
    rnd = np.random.default_rng(1)
    codes = [rnd.integers(0, k, 60) for k in (5, 3, 2)]
    tokens = rnd.random(60) * 100 + 1
    targets = [rnd.random(k) + 0.2 for k in (5, 3, 2)]
    w = mixing.rake(tokens, codes, targets)
    for c, t in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(c, tokens * w) / tokens.sum(), t / t.sum(), atol=1e-6)
    assert mixing.rake(np.zeros(3), [np.array([0, 1, 1])], [np.ones(2)]).tolist() == [1, 1, 1]


def test_topics(spark):
    texts = ["alpha beta ALPHA", "beta", "ONE, beta.", "alphabet", None, "beta beta one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in mixing.with_topic(df, "t", TOPICS, "topic").orderBy("i").select("topic").collect()] == ["a", "b", "a", "other", "other", "b"]


@pytest.mark.parametrize("keep", [None, 0.6])
def test_probabilities_give_the_targets(spark, keep):
    rnd = np.random.default_rng(2)
    rows = [(i, "alpha " * int(n) if rnd.random() < 0.4 else "words " * int(n), f"s{min(int(rnd.exponential(1.5)), 4)}", "en" if rnd.random() < 0.8 else "fr") for i, n in enumerate(rnd.integers(1, 60, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    margins = [Margin("source", power=0.5), Margin("lang", {"en": 0.6, "fr": 0.4}), Margin("topic", power=1.0)]
    mixed, mixture = mixing.mix(df, margins, TOPICS, keep)
    got = mixed.collect()
    assert all(0 <= r._probability <= 1 for r in got)
    kept = sum(r._tokens for r in got if r._kept)
    if keep:
        assert abs(sum(r._tokens * r._probability for r in got) / sum(r._tokens for r in got) - keep) < 0.01
    for i, name in enumerate(("_source", "_lang", "_topic")):
        share = defaultdict(float)
        for r in got:
            share[r[name]] += r._tokens * r._kept / kept
        for value, (_, target, expected) in mixture.shares[i].items():
            assert abs(share[value] - expected) < 0.05
            if keep is None:
                assert abs(expected - target) < 1e-6
    assert mixing.mix(df.repartition(7), margins, TOPICS, keep)[0].where("_kept").count() == sum(r._kept for r in got)


def test_targets_by_the_librarys_tokens(spark):
    """Targets are met by real tokens, and with a share to keep those that bounded raking can meet."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocabulary = queries.VOCABULARY
    tokenizer = Tokenizer.from_file(vocabulary.file)
    size = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
    for keep in (None, 0.7):
        mixed, _ = mixing.mix(df, queries.MARGINS, queries.TOPICS, keep, vocabulary=vocabulary)
        rows = mixed.collect()
        assert {r.doc_id: r._tokens for r in rows} == size
        whole = sum(size.values())
        expected = sum(r._tokens * r._probability for r in rows)
        assert keep is None or abs(expected - keep * whole) < 1e-3 * whole
        for margin in queries.MARGINS:
            before, after = Counter(), Counter()
            for r in rows:
                before[r[f"_{margin.name}"]] += r._tokens
                after[r[f"_{margin.name}"]] += r._tokens * r._probability
            want = {v: (n / whole) ** margin.power for v, n in before.items()}
            if keep is None:
                goal = {v: t / sum(want.values()) * expected for v, t in want.items()}
            else:
                # a value whose target is more than it has is kept whole, and the others share the rest
                goal, free, left = {}, dict(want), keep * whole
                while True:
                    scale = left / sum(free.values())
                    over = [v for v, t in free.items() if t * scale >= before[v]]
                    for v in over:
                        goal[v] = before[v]
                        left -= before[v]
                        del free[v]
                    if not over:
                        break
                goal |= {v: t * scale for v, t in free.items()}
            for v in goal:
                assert abs(after[v] - goal[v]) < 1e-3 * whole, (keep, margin.name, v)


def test_null_is_no_other_value(spark):
    df = spark.createDataFrame([(i, "x y z", [None, "(null)", "null"][i % 3], "en") for i in range(9)], "doc_id long, text string, source string, lang string")
    _, mixture = mixing.mix(df, [Margin("source"), Margin("lang"), Margin("topic")], TOPICS)
    assert set(mixture.shares[0]) == {mixing.NULL, "(null)", "null"}


def test_rest_falls_together(spark):
    df = spark.createDataFrame([(i, "x y z", f"s{i % 7}", None) for i in range(70)], "doc_id long, text string, source string, lang string")
    _, mixture = mixing.mix(df, [Margin("source", {"s0": 0.5, "s1": 0.2}), Margin("lang"), Margin("topic")], TOPICS)
    assert {k: round(v[2], 6) for k, v in mixture.shares[0].items()} == {"s0": 0.5, "s1": 0.2, "other": 0.3}
    _, mixture = mixing.mix(df, [Margin("source", most_values=2), Margin("lang"), Margin("topic")], TOPICS)
    assert set(mixture.shares[0]) == {"s0", "s1", "other"}


def test_every_value_has_its_target(spark):
    n = 230
    df = spark.createDataFrame([(i * 10 + j, "x " * (2 * (i + 1)), f"s{i}", "en") for i in range(n) for j in range(3)], "doc_id long, text string, source string, lang string")
    _, mixture = mixing.mix(df, [Margin("source", power=0.5), Margin("lang"), Margin("topic")], TOPICS)
    whole = sum((i + 1) ** 0.5 for i in range(n))
    assert len(mixture.shares[0]) == n
    for i in range(n):
        assert abs(mixture.shares[0][f"s{i}"][2] - (i + 1) ** 0.5 / whole) < 1e-6


def test_bounded_raking_meets_what_can_be_met():
    # by weight times scale and a cut at 1, c would get less than its target here, though it has the tokens
    tokens = np.array([50.0, 2, 20, 6, 10, 12])
    codes = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])]
    targets = [np.array([0.4, 0.29, 0.31]), np.array([0.73, 0.27])]
    p = mixing.rake_within(tokens, codes, targets, 0.7)
    for c, t in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(c, tokens * p) / (tokens * p).sum(), t, atol=1e-6)
    assert abs((tokens * p).sum() - 70) < 1e-6 and p.max() <= 1
    cut = tokens * np.minimum(mixing.rake(tokens, codes, targets) * 0.7, 1)
    assert np.bincount(codes[0], cut)[2] / cut.sum() < 0.309
    # out of reach: whole, and the rest in proportion
    assert np.allclose(mixing.attainable(np.array([60.0, 30, 10]), np.array([0.4, 0.3, 0.3]), 70), [240 / 7, 180 / 7, 10])


@pytest.mark.parametrize("keep", [None, 0.7])
def test_tables_and_arrays_agree(spark, monkeypatch, keep):
    rows = [(i, "alpha " * n if i % 3 else "words " * n, f"s{i % 4}", "en" if i % 5 else None) for i, n in enumerate([40, 3, 25, 7, 1, 60, 9, 12, 30, 2, 5, 80])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    margins = [Margin("source", power=0.5), Margin("lang", {"en": 0.8}), Margin("topic")]
    # the same steps: equal after any number of rounds
    for name in ("rake", "rake_within", "rake_table"):
        monkeypatch.setattr(mixing, name, partial(getattr(mixing, name), rounds=3))
    got = [{r.doc_id: r._probability for r in mixing.mix(df, margins, TOPICS, keep, most_cells=k)[0].collect()} for k in (0, 100)]
    assert got[0] == pytest.approx(got[1], abs=1e-9) and min(got[0].values()) > 0


def test_edges(spark):
    df = edges.frame(spark)
    margins = [Margin("source", power=0.5), Margin("lang", power=0.5), Margin("topic")]
    kept = mixing.sample(df, margins, TOPICS, keep=0.9)
    assert kept.columns == df.columns
    assert not Counter(kept.collect()) - Counter(df.collect())
    assert mixing.sample(edges.empty(spark), margins, TOPICS).count() == 0
