"""Best-fit packing of token sequences, hierarchically.

Documents are tokenised once into pieces (a table in shared storage). Each batch
of a partition is packed best-fit decreasing; nearly full bins are final, and
underfull bins become items of the next round, dealt over fewer groups by a
hash. A group never holds more than ``group_items`` items in the mean, whatever
the size of the corpus: rounds go on until everything has been in one group, or
a round leaves more than ``pays`` of the underfull bins before it, whose rest is
then final as it is. Where a piece stands is the sum of the shifts of its bins,
so only small rows (item, bin, shift) are ever joined.

Defined results: a null or empty text is the end mark alone, a piece of one
token; special strings inside texts become their ids, as in the library; only
documents over the limit are cut, and their first piece takes the remainder;
repeated rows are packed each; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged, tidy

_HIGH = 33  # ids are (task << _HIGH) + number within the task
#: Bits of a bin's id that say of which round it is.
_ROUND_BITS = 7


@dataclass(frozen=True)
class Vocabulary:
    """file: of the tokenizers library. ranks, pattern, special: the same vocabulary for a faster library, if there is such a file; ids are the same, and texts that it refuses go through the first one."""

    file: str
    ranks: str | None = None
    pattern: str = ""
    special: tuple[tuple[str, int], ...] = ()


@cache
def encoder(vocabulary: str):
    """The library's tokenizer, without truncation and padding; a task uses one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    out = tokenizers.Tokenizer.from_file(vocabulary)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def fast_encoder(vocabulary: Vocabulary):
    import tiktoken

    with open(vocabulary.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))


def token_ids(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """The ids of a text, without added special tokens; special strings in it become their ids."""
    if vocabulary.ranks:
        try:
            return fast_encoder(vocabulary).encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern can't go through some hundred thousand white characters in a row
            pass
    return np.array(encoder(vocabulary.file).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """Begin and end of the pieces of n tokens; the first piece takes what is left over."""
    first = n % limit or min(n, limit)
    return [(0, first), *((i, i + limit) for i in range(first, n, limit))]


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill. An int of limit + 1 bits says for which room there are bins."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), limit
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, fills


def pieces(docs: DataFrame, vocabulary: Vocabulary, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with an id that is unique in the table once it is written."""

    def made(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << _HIGH
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", vocabulary), np.uint32(end_id)).astype("<u4")
                for k, (a, b) in enumerate(cut(len(ids), limit)):
                    rows.append((row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            at, piece, start, length, crc = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64) for _ in range(5))
            ids = np.arange(next_id, next_id + len(at))
            next_id += len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(ids)], ["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(made), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, item long")


def pack_batches(items: DataFrame, limit: int, nearly_full: int, round_no: int, whole: bool = False) -> DataFrame:
    """items (item, length) to (item, bin, shift, fill, done). Each batch, or with whole each task, is packed by itself; bins get ids of this round."""

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        next_bin = (TaskContext.get().partitionId() << _HIGH) + 0
        held = list(batches) if whole else batches
        for batch in [pa.Table.from_batches(held).combine_chunks()] if whole and held else [] if whole else held:
            sizes = batch.column("length").to_numpy()
            bins, offsets, fills = best_fit(sizes, limit)
            fill = np.array(fills, np.int64)[bins] if len(bins) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("item").to_numpy()), pa.array(bins + next_bin), pa.array(offsets), pa.array(fill), pa.array(fill >= nearly_full)], ["item", "bin", "shift", "fill", "done"])
            next_bin += len(fills)

    made = items.select("item", "length").mapInArrow(tidy(packed), "item long, bin long, shift long, fill long, done boolean")
    # the round in the low bits keeps ids of different rounds apart
    return made.withColumn("bin", F.shiftleft("bin", _ROUND_BITS) + round_no)


def pack(table: DataFrame, limit: int, scratch: Scratch, slack: int = 8, group_items: int = 200_000, pays: float = 0.9) -> DataFrame:
    """A written table of pieces, with sequence_id and offset."""
    placed = scratch.table("round0", pack_batches(table, limit, limit - slack, 0))
    # item to its present bin and its offset there, for open bins of the first round only
    open_bins = placed.where("not done").select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
    moves: DataFrame | None = None
    before, r = None, 0
    while True:
        n, r = open_bins.count(), r + 1
        # each round leaves at most that share, so rounds are few whatever the size: 7 bits are enough for 200,000 times 0.9 ** -127 bins
        if n <= 1 or before is not None and n > pays * before:
            break
        groups, before = max(1, -(-n // group_items)), n
        dealt = open_bins.repartition(groups, F.xxhash64("item", F.lit(r)))
        step = scratch.table(f"round{r}", pack_batches(dealt, limit, limit - slack, r, whole=True))
        if moves is None:
            moves = step.select(F.col("item").alias("first"), "bin", "shift")
        else:
            up = step.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("shift").alias("more"))
            moves = moves.join(merged(up), "bin", "left").select("first", F.coalesce("to", "bin").alias("bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        if groups == 1:
            break
        open_bins = step.where("not done").select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
    out = table.join(merged(placed.select("item", "bin", "shift")), "item")
    if moves is not None:
        out = out.join(merged(moves.select(F.col("first").alias("bin"), F.col("bin").alias("to"), F.col("shift").alias("more"))), "bin", "left")
        out = out.withColumns({"shift": F.col("shift") + F.coalesce("more", F.lit(0)), "bin": F.coalesce("to", "bin")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, end_id: int, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The packed pieces of all documents."""
    scratch = Scratch(docs.sparkSession, "packing")
    table = scratch.table("pieces", pieces(docs, vocabulary, end_id, limit, id_col, text_col))
    return pack(table, limit, scratch, **how)
