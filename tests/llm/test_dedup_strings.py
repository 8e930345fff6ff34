"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaflow.llm import substring_dedup, suffix_dedup, windows
from glossaflow.llm.common import Scratch
from glossaflow.llm.windows import Shape

from . import edges


def key(r):
    return (r.doc_id is not None, r.doc_id or 0)


def brute_words(rows, size):
    """A set of identical rows is one document."""
    rows = sorted(set((key(r), r.doc_id, r.text or "") for r in rows))
    # rows of one id but different texts are ordered by the hash of the text; the fixtures have none that share windows
    seen, out = set(), {}
    for _, doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone[s : s + size] = True
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id, text] = (len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(texts, size):
    count = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        count.update(hash(b[s : s + size]) for s in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if count[hash(b[s : s + size])] > 1:
                gone[s : s + size] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("batches", "most"), [(1, 20_000), (4, 1)])
def test_substrings(spark, batches, most):
    for _, df in edges.both(spark):
        rows = df.collect()
        want = brute_words(rows, 20)
        got = substring_dedup.dedup(df, batches=batches, most=most).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((r.doc_id, *want[r.doc_id, r.text or ""]) for r in rows)
    assert substring_dedup.dedup(edges.empty(spark)).count() == 0


def test_without_filters(spark, monkeypatch):
    """What a corpus gives whose repeated grams and members are too many for a filter."""
    monkeypatch.setattr(windows, "FILTER_ROWS", 0)
    for _, df in edges.both(spark):
        rows = df.collect()
        want = brute_words(rows, 20)
        got = substring_dedup.dedup(df, batches=2).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((r.doc_id, *want[r.doc_id, r.text or ""]) for r in rows)
        got = suffix_dedup.dedup(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r.doc_id, *x) for r, x in zip(rows, brute_bytes([r.text for r in rows], 400), strict=True))


@pytest.mark.parametrize("most", [5_000, 1])
def test_suffixes(spark, most):
    for _, df in edges.both(spark):
        rows = df.collect()
        got = suffix_dedup.dedup(df, most=most).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r.doc_id, *x) for r, x in zip(rows, brute_bytes([r.text for r in rows], 400), strict=True))
    assert suffix_dedup.dedup(edges.empty(spark)).count() == 0


def test_members_of_large_classes_stay_apart(spark):
    """Copies of one text are not dealt to one task for each class that they share."""
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(500))
    df = spark.createDataFrame([(i, text) for i in range(400)], "doc_id long, text string").repartition(8)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    scratch = Scratch(spark, "test")
    try:
        for k, v in zip(held, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        spans, _ = suffix_dedup.repeated_spans(windows.named(df, "doc_id", "text"), Shape(400, 128, "byte"), scratch, most=50)
        rows = spans.select("doc_id", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    at = Counter(r[1] for r in rows)
    assert {r[0] for r in rows} == set(range(400))
    assert max(at.values()) < sum(at.values()) / 2


def test_small_alphabets(spark, monkeypatch):
    """Many overlapping repeats, and documents cut into stretches."""
    rnd = random.Random(8)
    base = "".join(rnd.choice("ab ") for _ in range(300))
    texts = [base, base[40:200] + "x" + base[:90], "ab" * 200, " ".join(rnd.choice("ab") for _ in range(400)), "b".join([base[100:180]] * 4)] + ["".join(rnd.choice("ab ") for _ in range(250)) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup(df, Shape(24, 8, "byte")).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(i, *x) for i, x in enumerate(brute_bytes(texts, 24))}
    got = substring_dedup.dedup(df, Shape(6, 2, "word"), batches=3).collect()
    want = brute_words(df.collect(), 6)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *want[i, t]) for i, t in enumerate(texts)}


def test_stretches_overlap_by_a_window(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (700, 3, 0, 50, 400)]
    shape = Shape(10, 4, "byte")

    def all_windows():
        out = set()
        for values, rows, begins, ends, before in windows.stretches(pa.array(texts), shape):
            e = windows.entries_of(windows.prefix_hash(values), rows, begins, ends, before, shape)
            for r, p, lo, hi in zip(e.row.tolist(), e.place.tolist(), e.lo.tolist(), e.hi.tolist(), strict=True):
                for l in range(lo, hi + 1):  # noqa: E741
                    assert (r, p - l) not in out
                    out.add((r, p - l))
        return out

    want = {(r, s) for r, t in enumerate(texts) for s in range(len(t) - 9)}
    assert all_windows() == want
    monkeypatch.setattr(windows, "STRETCH", 64)
    assert all_windows() == want


def test_deep_shallow_sorts():
    rnd = random.Random(10)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [b"a" * 50] * 5 + [b"a" * k for k in range(60)]
    for groups in ([list(range(len(strings)))], [list(range(0, 100)), list(range(100, len(strings)))]):
        order, lcp = suffix_dedup.deep_shallow(strings, groups, shallow=4)
        at = 0
        for g in groups:
            got = [strings[i] for i in order[at : at + len(g)]]
            assert got == sorted(strings[i] for i in g) and lcp[at] == -1
            for a, b, n in zip(got, got[1:], lcp[at + 1 : at + len(g)], strict=False):
                assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or a == b and n == len(a)
            at += len(g)


def test_runs_merge_and_compact(spark):
    df = windows.named(edges.documents(spark), "doc_id", "text")
    scratch = Scratch(spark, "test")
    one = {r.gram for r in substring_dedup.FingerprintIndex(spark, scratch).add(df).collect()}
    index = substring_dedup.FingerprintIndex(spark, Scratch(spark, "test"), most_runs=2)
    several = set()
    for part in substring_dedup.batches_by_id(df, 5):
        several |= {r.gram for r in index.add(part).collect()}
        assert len(index.runs) <= 2
    assert one == several
    index.close()


def test_runs_are_joined_without_a_shuffle(spark):
    df = windows.named(edges.documents(spark), "doc_id", "text")
    index = substring_dedup.FingerprintIndex(spark, Scratch(spark, "test"))
    for part in substring_dedup.batches_by_id(df, 2):
        index.add(part)
    a, b = (index.run(x) for x in index.runs)
    plan = a.where("n = 1").join(b.hint("merge"), "gram", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_an_index_goes_on(spark, tmp_path):
    """Three calls over parts of the documents, the index kept between them, give what one call over all gives."""
    docs = edges.documents(spark)
    rows = lambda df: {tuple(r) for r in df.collect()}
    want, got = rows(substring_dedup.dedup(docs)), set()
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    cuts = [ids[0], ids[len(ids) // 3], ids[len(ids) // 2], ids[-1] + 1]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        new = docs.where((docs.doc_id >= lo) & (docs.doc_id < hi))
        got |= rows(substring_dedup.dedup(new, batches=2, history=docs.where(docs.doc_id < lo), folder=f"file://{tmp_path}/index"))
    assert got == want
    with pytest.raises(ValueError, match="other windows"):
        substring_dedup.FingerprintIndex(spark, Scratch(spark, "test"), Shape(7, 2, "word"), folder=f"file://{tmp_path}/index")


def test_batches_of_any_ids(spark):
    rows = [(None if i % 50 == 0 else f"k{i}", i) for i in range(400)] + [("k7", 1000 + i) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, x long")
    parts = substring_dedup.batches_by_id(df, 5)
    held = [{r.x for r in p.collect()} for p in parts]
    assert len(parts) > 2 and set.union(*held) == {x for _, x in rows} and sum(map(len, held)) == len(rows)
    assert {x for i, x in rows if i is None} <= held[0]


def test_a_broken_index_is_an_error(spark, tmp_path):
    """A cut state, a missing one and lost runs are told of; a state that was being written counts for nothing."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(30))) for i in range(30)], "doc_id long, text string")
    index, shape = tmp_path / "index", Shape(7, 2, "word")
    build = lambda: substring_dedup.dedup(docs, shape, batches=2, folder=f"file://{index}")
    opened = lambda: substring_dedup.FingerprintIndex(spark, Scratch(spark, "test"), shape, folder=f"file://{index}")
    build()
    runs = opened().runs
    (index / "_state-half").write_text('{"runs": [')
    assert runs and opened().runs == runs and len(list(index.glob("state-*.json"))) <= 2
    state = max(index.glob("state-*.json"))
    whole = state.read_text()
    for cut in ("", whole[:20]):
        (index / f".{state.name}.crc").unlink(missing_ok=True)
        state.write_text(cut)
        with pytest.raises(LookupError, match="cannot be read"):
            opened()
    for p in index.glob("state-*.json"):
        p.unlink()
    with pytest.raises(LookupError, match="no state"):
        opened()
    state.write_text(whole)
    shutil.move(index / runs[0], tmp_path / "elsewhere")
    with pytest.raises(LookupError, match="lost"):
        opened()
