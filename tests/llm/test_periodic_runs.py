"""Runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossaflow.llm import periodic_runs, queries
from glossaflow.llm.periodic_runs import Least

from . import edges


def brute(words, least=Least()):
    """(start, length, period) of every run, each period tried at each place."""
    found = {}
    for q in range(1, len(words) // least.periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least.words, least.periods * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_words():
    rnd = random.Random(2)
    for _ in range(600):
        texts, least = [], Least(*rnd.choice([(6, 4), (6, 4), (10, 4), (4, 4), (3, 5)]))
        for _ in range(rnd.randrange(1, 6)):
            w = []
            while rnd.random() < 0.8:
                part = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefg") for _ in range(rnd.randrange(1, 7))]
                w += part * rnd.choice([1, 1, 2, 4, 5, 9])
                w = w[: len(w) - rnd.randrange(2)]
            texts.append(rnd.choice([" ".join(w), " " + "\n".join(w) + "\t", "\x0b\x0c".join(w) or None]))
        runs, collapsed = periodic_runs._slice(pa.array(texts, pa.string()), least)
        for text, r, c in zip(texts, runs.to_pylist(), collapsed.to_pylist(), strict=True):
            want = brute(split(text), least)
            assert [(x["start"], x["length"], x["period"]) for x in r] == want and c == collapse(split(text), want)


def test_overlap_is_the_least_of_any_run():
    for least in (Least(), Least(10, 4), Least(1, 4), Least(9, 5), Least(40, 4)):
        assert least.overlap == min(max(least.words, least.periods * q) - q for q in range(1, 100))
    with pytest.raises(ValueError, match="four"):
        Least(6, 3)


def test_a_wrong_hash_changes_nothing(monkeypatch):
    """With hashes of which many stretches share one, runs are still those of the words."""
    real = periodic_runs.span_hash
    monkeypatch.setattr(periodic_runs, "span_hash", lambda *a: real(*a) % 3)
    rnd = random.Random(5)
    for _ in range(60):
        text = " ".join(rnd.choice(["a b " * 5, "c " * 7, "a ", "b c "]) for _ in range(6))
        runs, _ = periodic_runs._slice(pa.array([text]), Least())
        assert [(x["start"], x["length"], x["period"]) for x in runs[0].as_py()] == brute(text.split())


def test_edges(spark):
    for _, df in edges.both(spark):
        got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.with_runs(df).collect()), key=repr)
        want = []
        for r in df.collect():
            words = split(r.text) if len(r.text or "") < 100_000 else None
            runs = brute(words) if words is not None else []  # the very long text is of random words
            want.append((r.doc_id, runs, collapse(words if words is not None else split(r.text), runs)))
        assert got == sorted(want, key=repr)
    assert periodic_runs.digest(periodic_runs.with_runs(periodic_runs.with_planted(edges.empty(spark)))).count() == 0


def test_a_very_long_period(spark):
    text = " ".join(["a b"] * 150_000 + [f"w{i}" for i in range(100_000)])
    r = periodic_runs.with_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 2)] and len(r.collapsed.split()) == 100_002


def _digest(doc_id, text):
    words = split(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(((n, -s, -q) for s, n, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(words, runs)))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{edges.SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, edges.SF).collect()]
    assert sorted(got) == sorted(_digest(*x) for x in docs if len(x[1] or "") < 10**6)
    rnd = random.Random(4)
    rows = [(i if i % 7 else None, " ".join(rnd.choice("abc") for _ in range(i % 90))) for i in range(400)]
    planted = periodic_runs.with_planted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")))
    made = periodic_runs.digest(periodic_runs.with_runs(planted)).collect()
    assert sorted(map(tuple, made), key=repr) == sorted((_digest(*x) for x in rows), key=repr)
