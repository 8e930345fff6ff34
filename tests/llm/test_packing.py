"""Packing: pieces against the tokenizers library, places gapless, close to the least number of sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glossaflow.llm import packing, queries
from glossaflow.llm.common import Scratch

from . import edges


def packed(df, **how):
    return packing.pack_documents(df, queries.VOCABULARY, queries.END_ID, 1024, **how)


def gapless(rows, limit):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    return len(held)


def test_pieces_and_places(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _, df in edges.both(spark):
        rows = packed(df).collect()
        want = []
        for r in df.collect():
            ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
            want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
        n = gapless(rows, 1024)
        assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1
    assert packed(edges.empty(spark)).count() == 0


def test_a_million_white_characters(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " \t" * 300_000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    for out in (packed(df), corpus_pipeline.packed(spark, df, "")):
        rows = out.collect()
        assert {i: sum(r.length for r in rows if r.doc_id == i) for i in want} == want
        gapless(rows, 1024)


def test_rounds_of_merging(spark):
    rnd = np.random.default_rng(2)
    sizes = [int(x) for x in rnd.integers(1, 1025, 6000)]
    table = spark.createDataFrame([(i, 0, 0, s, 0, i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, item long").repartition(60)
    scratch = Scratch(spark, "test")
    rows = packing.pack(scratch.table("pieces", table), 1024, scratch, group_items=500).collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    assert gapless(rows, 1024) <= 1.03 * sum(sizes) / 1024


def test_items_that_never_share_a_bin(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"), F.col("id").alias("item"))
    scratch = Scratch(spark, "test")
    rows = packing.pack(scratch.table("pieces", table), 1024, scratch, group_items=100).collect()
    assert gapless(rows, 1024) == 3000
