"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossaflow.llm import ranked_search

from . import edges


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranked_search.TERM, low)


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            score = 0
            for t, often in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += often * w * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score:
                scored.append((-score, (i is not None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


SMALL = {"most_rows": 100, "most_postings": 3000}


@pytest.mark.parametrize("sizes", [{}, SMALL, {"most_items": 3}, {"most_terms": 300, **SMALL}, {"most_rows": 1}])
def test_edges(spark, sizes):
    docs = [(r.doc_id, r.text) for r in edges.frame(spark).collect()]
    items = [(1, "one a B words"), (2, None), (3, ""), (4, "LINE line here"), (5, docs[6][1]), (6, docs[9][1]), (6, "x y"), (None, "two nothing"), (1, "one a B words"), (8, "unheard"), (9, "blo1 b")]
    table = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, ranked_search.rank(edges.frame(spark), table, 4, **sizes).collect()), key=repr)
    assert got == brute(docs, sorted({x for x in items if x[1] is not None}, key=repr), 4)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    kind = [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    for docs, held in ((edges.empty(spark), items), (edges.frame(spark), items.where("false")), (edges.frame(spark).where("doc_id = 0"), items)):
        made = ranked_search.rank(docs, held)
        assert made.count() == 0 and made.dtypes == kind


def test_ties_go_by_id(spark):
    """Hundreds of equal documents in many ranges: the least ids are ranked."""
    ids = list(range(900))
    random.Random(1).shuffle(ids)
    docs = [(i, "same words here" if i % 3 else "other words") for i in ids]
    items = [(1, "same"), (2, "words other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ranked_search.rank(frame, spark.createDataFrame(items, "item_id long, text string"), 20, most_rows=70).collect()), key=repr)
    assert got == brute(docs, items, 20)


def test_bounds_hold_and_no_leaf_is_opened_in_vain(monkeypatch):
    rng = np.random.default_rng(3)
    n, n_terms = 4096, 60
    at, tf = [], []
    for t in range(n_terms):
        held = np.sort(rng.choice(n, rng.integers(1, 600), replace=False))
        at.append(held)
        tf.append(rng.geometric(0.4, len(held)) + 40 * (held == 77))
    lengths = rng.integers(20, 3000, n)
    one = ranked_search.Range(np.arange(n_terms), np.array([len(x) for x in at]), lengths, np.concatenate(at), np.concatenate(tf), rng.integers(1, 9000, n_terms), n, int(lengths.sum()))
    opened = []
    real = ranked_search.Range.leaf
    monkeypatch.setattr(ranked_search.Range, "leaf", lambda self, r, o, b: opened.append(b) or real(self, r, o, b))
    scores = defaultdict(dict)
    for t in range(n_terms):
        for a, s in zip(at[t].tolist(), one.adds[sum(map(len, at[:t])) : sum(map(len, at[: t + 1]))].tolist(), strict=True):
            scores[t][a] = s
    for item in ({3: 1}, {1: 2, 5: 1}, {t: 1 for t in range(8)}, {59: 3, 0: 1, 70: 1}):
        every = Counter()
        for t, often in item.items():
            for a, s in scores[t].items():
                every[a] += often * s
        want = sorted(((s, a) for a, s in every.items() if s), key=lambda x: (-x[0], x[1]))
        opened.clear()
        assert one.search(item, 10, 1, lambda a: a) == want[:10]
        # best first: no leaf is opened whose bound is under the last score that is ranked, and none twice
        rows, often = one.asked(item)
        bounds = often @ one.levels[0][rows]
        assert len(opened) == len(set(opened)) and all(bounds[b] >= want[9][0] for b in opened)
        opened.clear()
        assert one.search(item, 1, 1, lambda a: a) == want[:1] and (len(opened) < 40 or len(rows) > 2)
        assert one.search(item, 10, want[3][0], lambda a: a) == [x for x in want[:10] if x[0] >= want[3][0]]
        assert one.bound(*one.asked(item)) >= want[0][0]
    assert one.search({99: 1}, 5, 1, lambda a: a) == []
