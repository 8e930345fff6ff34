"""The n-gram join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaflow.llm import ngram_join
from glossaflow.llm.common import Scratch
from glossaflow.llm.components import components
from glossaflow.llm.ngram_join import Join

from . import edges


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, how):
    sets = [shingles(r.text, how.n) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and how.den * len(sets[i] & sets[j]) >= how.num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def result(df, how, **limits):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.with_components(df, how, **limits).collect())


def near_copies(seed=1):
    """Chains and stars of edited texts of many sizes, and a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(900)}"
    texts, passage = [], " ".join(word() for _ in range(40))
    for size in (1, 2, 3, 8, 11, 12, 13, 21, 22, 31, 33, 45, 80, 200):
        base = [word() for _ in range(size)]
        for _ in range(7):
            base = list(base)
            if rnd.random() < 0.8:
                at = rnd.choice([0, len(base) - 1, rnd.randrange(len(base))])
                base[at : at + rnd.randrange(2)] = [word() for _ in range(rnd.randrange(3))]
                base = base or [word()]
            texts.append(" ".join(base))
    texts += [passage + " " + " ".join(word() for _ in range(rnd.randrange(4))) for _ in range(40)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("how", [Join(), Join(5, 80, 100)])
def test_equals_all_pairs(spark, how):
    tables = [df for _, df in edges.both(spark)] + [spark.createDataFrame([(i, t) for i, t in enumerate(near_copies())], "doc_id long, text string")]
    for df in tables:
        assert result(df, how) == brute(df.collect(), how)
    assert ngram_join.with_components(edges.empty(spark), how).count() == 0


@pytest.mark.parametrize("limits", [{"most_rounds": 0}, {"most_rounds": 4, "pair_budget": 0}])
def test_rounds_do_not_change_links(spark, limits):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(2))], "doc_id long, text string")
    assert result(df, Join(), **limits) == brute(df.collect(), Join())


def test_rounds_of_hubs(spark, monkeypatch):
    """Lists of more than two members go through several rounds; nearly similar sets are never joined by them."""
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    texts = near_copies(4)
    for k in (4, 8, 12):
        for _ in range(25):
            copy = list(base)
            for at in rnd.sample(range(150), k):
                copy[at] = f"x{rnd.randrange(10_000)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(df, Join(), most_rounds=3, pair_budget=0) == brute(df.collect(), Join())


@pytest.mark.parametrize("light", [0, 25])
def test_any_border_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(ngram_join, "border", lambda *_: light)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(3))], "doc_id long, text string")
    assert result(df, Join()) == brute(df.collect(), Join())


def test_parity_bits_bound_the_difference():
    rnd = np.random.default_rng(6)
    for size in (1, 50, 3000):
        a = rnd.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[: size // 2], rnd.integers(0, 2**63, 40).astype(np.uint64)])
        differ = sum(bin(int(x)).count("1") for x in (ngram_join.parity_bits(a) ^ ngram_join.parity_bits(b)).view(np.uint64))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_one_of_each(spark):
    df = edges.frame(spark)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    found = [(r.doc_id, r.component_id) for r in ngram_join.with_components(df).collect()]
    assert {r.doc_id for r in kept.collect()} == {a for a, b in found if a == b}


def test_one_row_of_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "y"), (1, a, "x"), (1, a, "x"), (2, a, "x"), (3, b + " m", "x"), (3, b + " n", "x"), (None, c, "x"), (None, c + " z", "x"), (None, c, "w"), (None, "u v w", "x"), (5, None, "x"), (5, "", "x"), (6, "", "x"), (None, a, "x")]
    for schema in ("doc_id long, text string, k string", "doc_id long, text string, k map<string,string>"):
        df = spark.createDataFrame([(i, t, {"k": k} if "map" in schema else k) for i, t, k in rows], schema).repartition(3)
        kept = ngram_join.one_of_each(df).collect()
        key = lambda r: r.k["k"] if "map" in schema else r.k
        assert Counter((r.doc_id, (r.text or "")[:1]) for r in kept) == Counter([(1, "a"), (3, "b"), (None, "c"), (None, "u"), (5, ""), (6, "")])
        assert [key(r) for r in kept if r.doc_id == 1] == ["x"]


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "test"), "c").collect())
    parent = {x: x for p in pairs for x in p}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def template(k, replaced, seed=3, vocabulary=10**6):
    """k texts of a template of 100 words, some of each replaced: similar, but not similar enough."""
    rnd = random.Random(seed)
    base, texts = [f"t{i}" for i in range(100)], []
    for _ in range(k):
        copy = list(base)
        for at in rnd.sample(range(100), replaced):
            copy[at] = f"x{rnd.randrange(vocabulary)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("vocabulary", [10**6, 2000])
def test_a_template_is_not_joined_in_full(spark, monkeypatch, vocabulary):
    """Of the pairs of long lists the last round meets some hundredths, and hands on fewer than there are texts."""
    met = {}
    real, pairs = ngram_join._cells, ngram_join._cell_pairs

    def counted(left, how):
        a, b = real(left, how)
        met["cells"] = a.join(b, (a["token"] == b["token"]) & (a["acell"] == b["bcell"])).count()
        met["all"] = left.groupBy("token").count().selectExpr("sum(count * count)").first()[0]
        return a, b

    def handed_on(left, how):
        out = pairs(left, how)
        met["pairs"] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "_cells", counted)
    monkeypatch.setattr(ngram_join, "_cell_pairs", handed_on)
    df = spark.createDataFrame(list(enumerate(template(1200, 3, vocabulary=vocabulary))), "doc_id long, text string")
    got = ngram_join.with_components(df, Join()).collect()
    assert len(got) == 1200 and sum(r.component_id == r.doc_id for r in got) > 1100
    assert met["all"] > 10**6 and met["cells"] < 0.03 * met["all"] and met["pairs"] < 1200


def test_a_template_with_near_copies(spark):
    """Some of the texts of a template are near enough to others, with few words replaced, or with those of another text."""
    texts = template(150, 3) + template(60, 1, 4) + template(40, 2, 5, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in (Join(), Join(5, 80, 100)):
        assert result(df, how) == brute(df.collect(), how)


def test_hubs_and_members_meet_once(spark):
    """Copies that share many long lists meet in the shortest of these alone; before, 40 sets of 30 lists met 30 times each."""
    how, zeros = Join(5, 80, 100), [F.lit(0).cast("long").alias(f"s{i}") for i in range(8)]
    rows = [(t, sid, 100, t, 80, sid, 40 + t) for t in range(30) for sid in range(40)]
    left = spark.createDataFrame(rows, "token long, sid long, n int, place int, common int, comp long, members long").select("*", *zeros)
    plain = ngram_join._with_shorter(left)
    a, b = ngram_join._sides(plain, plain)
    met = b.join(a, "token").where("asid <> bsid").groupBy("asid", "bsid").agg(F.sum(F.when(~F.arrays_overlap("abefore", "bbefore"), 1)).alias("k"), F.count(F.lit(1)).alias("all"))
    assert [tuple(r) for r in met.select("k", "all").distinct().collect()] == [(1, 30)]
    got = ngram_join._hub_pairs(left, how, 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("arrays_overlap") == 1
    assert {r.v for r in got.collect()} == set(range(40))
