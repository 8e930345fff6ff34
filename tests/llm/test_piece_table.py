"""SentencePiece by chunks against the library."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from glossaflow.llm import piece_table

from . import edges

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), library.decode(ids)


def test_chunks_of_random_strings(library):
    rnd = random.Random(1)
    letters = [*"abcehtin  \n\r\t▁.,é中0", "  ", "   ", "ing", " the", "😀", "\0", "\n\n", "<s>", "</s>", "<0x0A>", "<unk>", " \n ", "́", "​", "\xa0", "　"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        chunks = [c for part in piece_table.portions(text, rnd.choice([3, 10, 1000])) for c in piece_table._CHUNK.findall(part)]
        assert b"".join(piece_table.segment(chunks, MODEL)) == np.array(library.encode(text), "<u4").tobytes()


@pytest.mark.parametrize("sizes", [{}, {"letters": 1}, {"letters": 5000, "bucket_bytes": 10_000, "most_common": 50}, {"most_common": 0, "letters": 20_000}])
def test_equals_the_library(spark, library, sizes):
    """Blocks of all documents, of one, several blocks with many buckets, and no common chunks."""
    for _, df in edges.both(spark):
        got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in piece_table.encoded(df, MODEL, **sizes).collect())
        assert got == Counter((r.doc_id, *brute(library, r.text)) for r in df.select("doc_id", "text").collect())
    assert piece_table.encoded(edges.empty(spark), MODEL, **sizes).count() == 0


def test_long_texts(spark, library):
    texts = ["ab c\n" * 600_000, "ü" * 200_000, " " * 100_000, "\n" * 100_000, "x " * 700_000 + "▁y"]
    got = piece_table.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()
    assert {r.doc_id: (bytes(r.ids), r.decoded) for r in got} == {i: brute(library, t) for i, t in enumerate(texts)}


def test_a_chunk_is_in_one_bucket(spark):
    """So one task segments it, however many blocks hold it; a block asks for it once."""
    docs = edges.frame(spark).repartition(5).select("doc_id", "text")
    common = piece_table.common_chunks(docs, 10**6, MODEL, 9, 10**6)
    assert len(common[0]) == len(set(common[0])) == 10 and common[1].sum() == len(common[2])
    rows = piece_table.blocks_of(docs, 7, 3000, spark.sparkContext.broadcast(common)).where("bucket >= 0").collect()
    held = [(r.block, r.bucket, x) for r in rows for x in pa.decompress(r.payload, r.size, "zstd", asbytes=True).decode().split("\n")]
    assert len({r.block for r in rows}) > 5 and len(held) == len({(b, x) for b, _, x in held})
    assert len({(k, x) for _, k, x in held}) == len({x for _, _, x in held})
    want = {c for r in docs.collect() for chunks in piece_table.chunks_of(r.text or "") for c in chunks} - set(common[0])
    assert {x for _, _, x in held} == want


def test_models_that_do_not_fit(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    def changed(change):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as f:
            spec.ParseFromString(f.read())
        change(spec)
        path = tmp_path / "changed.model"
        path.write_bytes(spec.SerializeToString())
        return str(path)

    piece_table.check(MODEL)
    for change, why in (
        (lambda s: setattr(s.pieces[500], "piece", "a▁b"), "crosses"),
        (lambda s: setattr(s.pieces[500], "type", 4), "user-defined"),
        (lambda s: setattr(s.trainer_spec, "byte_fallback", False), "no bytes"),
        (lambda s: setattr(s.normalizer_spec, "remove_extra_whitespaces", True), "normaliser"),
    ):
        with pytest.raises(ValueError, match=why):
            piece_table.check(changed(change))
