"""SentencePiece ids and texts by a table of distinct chunks.

No piece of a fitting model goes on after a white space mark that follows other
characters, and none holds a line feed: a text, its spaces made marks, falls
into chunks (marks with the word after them, or one line feed) that are
segmented each by itself. So every distinct chunk
of the corpus is segmented once, by the library, and ids are joined back by
position:

* the commonest chunks of a bounded sample of texts, at most so many, are
  segmented first and go to all tasks. Which they are changes no result;
* texts are read in blocks of some megabytes. A block numbers its other chunks
  too, and is written as its documents' sequences of numbers, and its own chunks
  by ranges of their hash;
* the chunks of a range of hashes meet in one task, from all blocks. The task
  segments each once, and answers every block with the ids of its chunks;
* a block's sequences meet its answers in a join, each number becomes its
  chunk's ids, and the library decodes them.

What is written and shuffled is a block's own chunks and their ids, and two bytes
or so for each chunk of a text; texts are not shuffled.

``check`` refuses models to which this doesn't apply: pieces that cross marks or
hold line feeds, a normaliser that changes texts, no byte fallback, user-defined
pieces.

Defined results: a null or empty text has the begin and end ids alone and
decodes to an empty text; very long texts are cut into chunks by portions, and
one without any space is one chunk, whole; U+2581 is a space to the library,
and so it is here; repeated rows give a row each; columns other than id and
text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

MARK = "▁"
#: No piece holds it, so nothing is joined across it, before or behind.
BREAK = "\n"
_CHUNK = re.compile(r"\n| *[^ \n]+| +")
_BORDER = re.compile(r"\n|(?<=[^ \n]) ")


def check(model: str) -> None:
    """ValueError if chunks of texts cannot be segmented apart by this model."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        spec.ParseFromString(f.read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    pieces = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
    n, t = spec.normalizer_spec, spec.trainer_spec
    for wrong, why in (
        (n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces, "its normaliser does more than add and mark spaces"),
        (t.treat_whitespace_as_suffix, "its marks follow words"),
        (not t.byte_fallback, "characters that it doesn't know have no bytes"),
        (any(p.type == kinds.USER_DEFINED for p in spec.pieces), "it has user-defined pieces"),
        (any(re.search(f"[^{MARK}]{MARK}|{BREAK}", p) for p in pieces), "a piece crosses a mark or a line's end"),
    ):
        if wrong:
            raise ValueError(f"chunks cannot be segmented apart by {model}: {why}")


@cache
def _library(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def portions(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text as the model sees it, with its first space, in parts that end where a chunk does."""
    if not text:
        return
    held, begin = " " + text.replace(MARK, " "), 0
    while begin < len(held):
        border = _BORDER.search(held, begin + size) if len(held) - begin > size else None
        end = border.start() if border else len(held)
        yield held[begin:end] if begin or border else held
        begin = end


def chunks_of(text: str) -> Iterator[list[str]]:
    for part in portions(text):
        yield _CHUNK.findall(part)


def segment(chunks: list[str], model: str) -> list[bytes]:
    """The ids of each chunk, little-endian of 32 bits."""
    library = _library(model)
    before = library.encode(BREAK)
    out = []
    for begin in range(0, len(chunks), 4096):
        made = library.encode([BREAK + x for x in chunks[begin : begin + 4096]], num_threads=1)
        out += [np.array(x[len(before) :], "<u4").tobytes() for x in made]
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed by bytes of equal weight."""
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def _unpacked(held: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    if not n:
        return np.zeros(0, "<u4")
    planes = np.frombuffer(pa.decompress(held, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).reshape(-1).view("<u4")


class _Numbers(dict):
    """Numbers: those of the common chunks, then by first sight."""

    def __missing__(self, chunk: str) -> int:
        out = self[chunk] = len(self)
        return out


def _bucket_of(chunk: str, buckets: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(chunk) % buckets


BLOCK_TYPE = "block long, bucket int, n long, size long, payload binary, buckets binary, lengths array<int>"


def common_chunks(docs: DataFrame, size: int, model: str, most: int, sample_bytes: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most so many of the commonest short chunks in a sample of so many bytes by hash of id and text, the line feed first; how many ids each has, and these."""

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for chunks in chunks_of(text.as_py()):
                    seen.update(x for x in chunks if len(x) <= 64)
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])

    share = int(2**63 * min(1.0, sample_bytes / max(size, 1)))
    held = docs.where((F.col("text") != "") & (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= share - 1)).select("text")
    every = held.mapInArrow(tidy(counted), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    best = [r.chunk for r in every.where(F.col("chunk") != BREAK).orderBy(F.desc("n"), "chunk").limit(most).collect()]
    ids = segment([BREAK, *best], model)
    return [BREAK, *best], np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")


def blocks_of(docs: DataFrame, buckets: int, letters: int, common) -> DataFrame:
    """The blocks of docs (doc_id, text). Rows with bucket -1 hold a block's ids of documents, how many chunks each has, their numbers, and the bucket of each number beyond those of the common chunks; others hold the chunks of one bucket, in order of their numbers. common: the broadcast common chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        first = {x: i for i, x in enumerate(common.value[0])}
        names = ["block", "bucket", "n", "size", "payload", "buckets", "lengths", "ids"]

        def block(ids, texts):
            nonlocal made
            number, (seen, lengths, parts) = (task << 32) + made, (_Numbers(first), [], [])
            made += 1
            for text in texts:
                held = [np.array([seen[x] for x in chunks], np.uint32) for chunks in chunks_of(text)]
                lengths.append(sum(map(len, held)))
                parts += held
            every = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            chunks = list(seen)[len(first) :]
            places = np.array([_bucket_of(x, buckets) for x in chunks], np.int64)
            head = [pa.array([number]), pa.array([-1], pa.int32()), pa.array([len(every)]), pa.array([len(chunks)])]
            packed = [pa.array([_packed(x)], pa.binary()) for x in (every, places)]
            yield pa.RecordBatch.from_arrays([*head, *packed, pa.array([lengths], pa.list_(pa.int32())), one], names)
            by: dict[int, list[str]] = {}
            for place, x in zip(places.tolist(), chunks, strict=True):
                by.setdefault(place, []).append(x)
            n = len(by)
            joined = [BREAK.join(v).encode() for v in by.values()]
            head = [pa.array([number] * n, pa.int64()), pa.array(list(by), pa.int32()), pa.array([len(v) for v in by.values()], pa.int64()), pa.array([len(x) for x in joined], pa.int64())]
            packed = [pa.array([pa.compress(x, "zstd", asbytes=True) for x in joined], pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*head, *packed, pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, one.type)], names)

        ids, texts, size = [], [], 0
        for batch in batches:
            strings = batch.column(1)
            for i in range(len(batch)):
                text = strings[i].as_py() or ""
                if texts and size + len(text) > letters:
                    yield from block(pa.concat_arrays(ids), texts)
                    ids, texts, size = [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                texts.append(text)
                size += len(text) + 64
        if texts:
            yield from block(pa.concat_arrays(ids), texts)

    return docs.mapInArrow(tidy(run), f"{BLOCK_TYPE}, ids array<{kind}>")


def answers_of(parts: DataFrame, model: str, most: int = 2_000_000) -> DataFrame:
    """For the chunks of each block and bucket: how many ids each has, and these. Parts of a bucket come together in a task, which keeps what it has segmented, at most so many chunks."""

    def run(batches):
        import pyarrow as pa

        known: dict[str, bytes] = {}
        for batch in batches:
            for i in range(len(batch)):
                block, bucket, n, size, payload = (batch.column(c)[i].as_py() for c in range(5))
                chunks = pa.decompress(payload, size, "zstd", asbytes=True).decode().split(BREAK)
                if len(known) > most:
                    known.clear()
                fresh = [x for x in chunks if x not in known]
                known.update(zip(fresh, segment(fresh, model), strict=True))
                held = [known[x] for x in chunks]
                counts = np.fromiter(map(len, held), np.uint32, len(held)) // 4
                ids = np.frombuffer(b"".join(held), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([n]), pa.array([_packed(counts)], pa.binary()), pa.array([len(ids)]), pa.array([_packed(ids)], pa.binary())], ["block", "bucket", "n", "counts", "n_ids", "ids"])

    return parts.mapInArrow(tidy(run), "block long, bucket int, n long, counts binary, n_ids long, ids binary")


def _assembled(model: str, common):
    """Blocks with their answers to documents."""

    def run(batches):
        import pyarrow as pa

        library = _library(model)
        begin, end = (np.array([i], "<u4") for i in (library.bos_id(), library.eos_id()))
        _, first_counts, first_ids = common.value
        for batch in batches:
            for i in range(len(batch)):
                n, size, payload, buckets, lengths = (batch.column(c)[i].as_py() for c in ("n", "size", "payload", "buckets", "lengths"))
                found = sorted(batch.column("found")[i].as_py() or [], key=lambda x: x["bucket"])
                # the answers by bucket, and within one by number, as a stable sort by buckets has the numbers
                counts = np.concatenate([first_counts, *[_unpacked(x["counts"], x["n"]) for x in found]]).astype(np.int64)
                pieces = np.concatenate([first_ids, *[_unpacked(x["ids"], x["n_ids"]) for x in found]])
                shared = len(first_counts)
                order = np.concatenate([np.arange(shared), np.argsort(_unpacked(buckets, size), kind="stable") + shared])
                assert len(order) == len(counts), "a block lacks an answer"
                begins, many = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                begins[order], many[order] = np.cumsum(counts) - counts, counts
                numbers = _unpacked(payload, n)
                each = many[numbers]
                at = np.repeat(begins[numbers] - np.cumsum(each) + each, each) + np.arange(each.sum())
                every = pieces[at]
                edges = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths)])]
                ids = batch.column("ids")[i].values
                for first in range(0, len(lengths), 256):
                    own = [np.concatenate([begin, every[a:b], end]) for a, b in zip(edges[first : first + 256], edges[first + 1 : first + 257], strict=False)]
                    texts = [library.decode(x.tolist()) for x in own]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(own)), pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return tidy(run)


def _bucketed(spark, df: DataFrame, path: str, n: int) -> DataFrame:
    """df written to path by kind and in buckets by block. The catalog forgets the table when this process ends; the files go with the scratch folder."""

    def forget() -> None:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # at the end the session may be gone
                spark.sql(f"DROP TABLE IF EXISTS {name}")

    name = f"pieces_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy("kind").bucketBy(n, "block").sortBy("block").saveAsTable(name)
    atexit.register(forget)
    return spark.table(name)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", letters: int = 8_000_000, bucket_bytes: int = 64 << 20, most_common: int = 1 << 17, sample_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, ids (all, as little-endian unsigned 32-bit integers, with begin and end) and decoded, the text that the library makes of them. A block has about so many letters, or one text; a bucket of hashes gets the chunks of about so many bytes of texts; most_common and sample_bytes bound the chunks that go to all tasks, and the texts from which they are chosen."""
    check(model)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pieces")
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    size = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    common = spark.sparkContext.broadcast(common_chunks(held, size, model, most_common, sample_bytes))
    made = blocks_of(held, buckets, letters, common).withColumn("kind", F.when(F.col("bucket") < 0, "numbers").otherwise("chunks"))
    # a table in buckets by block, so that the numbers, the most of it, meet the answers where they lie
    blocks = _bucketed(spark, made, f"{scratch.top}/blocks", int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = blocks.where("kind = 'chunks'").select("block", "bucket", "n", "size", "payload")
    answers = scratch.table("answers", answers_of(parts.repartition(buckets, "bucket"), model))
    scratch.drop("blocks/kind=chunks")
    # the hint keeps Spark from moving the numbers to where the answers are
    found = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "counts", "n_ids", "ids")).alias("found"))
    numbers = blocks.where("kind = 'numbers'").select("block", "n", "size", "payload", "buckets", "lengths", "ids")
    # no order and no pair of blocks is needed: a block is one row on each side
    whole = numbers.join(found.hint("merge"), "block", "left").select("n", "size", "payload", "buckets", "lengths", "ids", "found")
    return whole.mapInArrow(_assembled(model, common), f"doc_id {kind}, ids binary, decoded string")
