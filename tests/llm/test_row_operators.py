"""Token counts, quality rules and fingerprints against brute force."""

import hashlib
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossaflow.llm import quality_rules, simhash, token_counts

from . import edges

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_token_counts_equal_the_library(spark, tokenizer):
    for _, df in edges.both(spark):
        got = token_counts.with_token_counts(df, JSON, 512).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect())
        assert Counter(map(tuple, got)) == want
    assert token_counts.with_token_counts(edges.empty(spark), JSON, 512).count() == 0


def test_counts_of_random_strings(tokenizer):
    rnd = np.random.default_rng(3)
    letters = list("a sStrevmld'\"RE \n\t!1é中½_") + ["<|endoftext|>", " ", "😀"]
    texts = ["".join(rnd.choice(letters, rnd.integers(0, 90))) for _ in range(3000)]
    counter, special = token_counts.compiled(JSON)
    assert token_counts.count_tokens(texts, counter, special).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_runs_come_back_to_the_same_states(tokenizer):
    counter, special = token_counts.compiled(JSON)
    token_counts.code_classes()
    random = "".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))
    for text in (" " * 300_000, "\n" * 100_000, "a" * 100_000, "-=" * 50_000, "\u3000" * 50_000, random):
        before, began = len(counter.states), time.process_time()
        assert token_counts.count_tokens([text], counter, special)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids)
        if text is not random:
            assert time.process_time() - began < 5 and len(counter.states) < before + 1000


def test_states_are_forgotten_beyond_the_bound():
    counter, _ = token_counts.compiled(JSON)
    few = token_counts.PairTransducer(counter.ranks, most=100, most_states=20)
    for text in ("unforgettablenesses" * 40, "漢字かな交じり文" * 30, "zqxjkv" * 50):
        assert few.count(text.encode()) == counter.count(text.encode())
        assert len(few.states) <= 20


def test_chunk_maps_compose(tokenizer):
    classes = np.random.default_rng(4).integers(0, token_counts.N_CLASSES, 5000).astype(np.uint8)
    whole = token_counts.pretoken_begins(classes, chunk=8192)
    for chunk in (1, 7, 64, 256):
        assert (token_counts.pretoken_begins(classes, chunk) == whole).all()


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality_rules(spark):
    for _, df in edges.both(spark):
        got = quality_rules.judged(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *brute_rules(r.text)) for r in df.collect())
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judged(edges.empty(spark)).count() == 0


def test_ledger_policies_and_ablation(spark):
    held = quality_rules.ledger(edges.frame(spark)).collect()
    policy = quality_rules.POLICIES[-1]
    names = [r.name for r in quality_rules.RULES]
    bad = [{n for i, n in enumerate(names) if r.failures >> i & 1} for r in held]
    got = {r.rule: (r.n_failed, r.n_only_this) for r in quality_rules.ablation(quality_rules.ledger(edges.frame(spark)), policy).collect()}
    for n in names:
        assert got.get(n, (0, 0)) == (sum(n in b for b in bad), sum(b == {n} for b in bad))


def test_keep_passing_keeps_whole_rows(spark):
    df = edges.frame(spark)
    kept = quality_rules.keep_passing(df)
    assert kept.schema.names == df.schema.names
    wanted = {r.doc_id for r in quality_rules.judged(df).where("kept").collect()}
    assert Counter(kept.collect()) == Counter(r for r in df.collect() if r.doc_id in wanted and not (r.doc_id is None and r.text is None))


def test_compared_texts(spark):
    for name, df in edges.both(spark):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
        got = simhash.compared(df).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
        if name == "documents":
            by_id = {r.doc_id: r for r in got}
            for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
                k = len(r.text) // 2
                edited = r.text[: len(r.text) - k] + after.text[:k]
                x = by_id[r.doc_id]
                assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and x.n_chars == len(r.text)
                assert x.near_next == 1 - bin(int(x.fingerprint, 16) ^ int(by_id[after.doc_id].fingerprint, 16)).count("1") / 128
                assert x.near_edited == 1 - bin(int(x.fingerprint, 16) ^ int(x.edited_fingerprint, 16)).count("1") / 128
            assert np.mean([x.near_edited > x.near_next for x in got]) > 0.9
    small = simhash.with_next(edges.documents(spark), rows_in_bucket=7).collect()
    rows = sorted(edges.documents(spark).collect(), key=lambda r: -r.doc_id)
    assert {(r.doc_id, r._next) for r in small} == {(r.doc_id, a.text) for r, a in zip(rows, rows[1:] + rows[:1], strict=True)}
    assert simhash.compared(edges.empty(spark)).count() == 0


def brute_fingerprint(text):
    """Votes counted bit by bit, with hashes by another library."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hash_of = lambda h, seed: xxhash.xxh64_intdigest(struct.pack("<q", signed(h)), seed % (1 << 64))
    terms = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    votes, whole = [0] * 128, 0
    for term in terms:
        x = 42
        for w in term:
            x = hash_of(xxhash.xxh64_intdigest(w.encode(), 42), x)
        y = xxhash.xxh64_intdigest(struct.pack("<i", 7), hash_of(x, 42))
        weight = sum(map(len, term)).bit_length()
        whole += weight
        for i in range(64):
            votes[i] += weight * (y >> i & 1)
            votes[64 + i] += weight * (x >> i & 1)
    return f"{sum(1 << i for i in range(128) if 2 * votes[i] > whole):032x}"


def test_fingerprints_are_the_votes(spark):
    for _, df in edges.both(spark):
        got = simhash.compared(df).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, brute_fingerprint(r.text)) for r in df.collect())
        prints = {r.fingerprint for r in got if r.doc_id is not None and r.doc_id % 50 == 0}
        for r in got:
            assert r.near_queries == sum(bin(int(r.fingerprint, 16) ^ int(q, 16)).count("1") <= simhash.RADIUS for q in prints)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_rows_of_any_ids(spark, kind):
    rnd = np.random.default_rng(8)
    ids = [*range(300), 10**15, -5, None, None, *[7] * 200]
    rows = [(i if i is None or kind == "long" else f"k{i}", f"text {n}") for n, i in enumerate(ids)]
    df = spark.createDataFrame([rows[i] for i in rnd.permutation(len(rows))], f"doc_id {kind}, text string").repartition(5)
    got = simhash.with_next(df, rows_in_bucket=20)
    assert max(r[0] for r in got.groupBy((F.col("_key") / (1 << 34)).cast("long")).count().select("count").collect()) <= 60
    got = got.collect()
    hashes = {r._t: r.h for r in got_hashes(df)}
    low = min(hashes.values()) - 1
    rows.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0 if kind == "long" else "", hashes.get(r[1], low)), reverse=True)
    assert {(r.doc_id, r._t, r._next) for r in got} == {(*r, a[1]) for r, a in zip(rows, rows[1:] + rows[:1], strict=True)}
    by_key = {r._key: r._t for r in got}
    assert len(by_key) == len(got) and all(by_key[r._next_key] == r._next for r in got)


def got_hashes(df):
    return df.select(F.col("text").alias("_t"), F.xxhash64("text").alias("h")).collect()


def test_all_fingerprints_within_a_radius(spark):
    rnd = np.random.default_rng(1)
    base = [int.from_bytes(rnd.bytes(16), "big") for _ in range(40)]
    near = [b ^ sum(1 << int(i) for i in rnd.choice(128, rnd.integers(0, 7), replace=False)) for b in base for _ in range(5)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in base + near], "fingerprint string")
    got = {(r.query, r.found): r.distance for r in simhash.within(df.limit(60), df, 4).collect()}
    queries = [r.fingerprint for r in df.limit(60).collect()]
    want = {(q, f): d for q in queries for f in {f"{x:032x}" for x in base + near} if (d := bin(int(q, 16) ^ int(f, 16)).count("1")) <= 4}
    assert got == want


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(edges.rows())], "k long, text string")
    prints = {r.k: r.fingerprint for r in simhash.fingerprints(df, ["k"], "text").collect()}
    by_text = {}
    for r in df.collect():
        assert by_text.setdefault(r.text or "", prints[r.k]) == prints[r.k]
    assert by_text[""] == by_text[" \n\t "] == "0" * 32
