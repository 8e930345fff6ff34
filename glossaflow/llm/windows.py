"""Repeated windows of a fixed length, found through sampled anchors.

A window of ``size`` units (bytes, or words) holds ``size - gram + 1`` grams; the
one with the least hash, the leftmost of equals, is its anchor. Equal windows
have equal anchors at equal places, wherever they stand, so only anchors are
ever shuffled: about two for every ``size - gram + 1`` units. The windows that
share an anchor are consecutive; an entry is an anchor with the range of its
windows. Entries whose whole stretch is equal form a class, and only one member
of a class needs a closer look.

Filters between passes are bitmaps of a fixed size that hold hashes: what they
let through beyond the wanted rows is removed by joins, so they bound the
volume and never the result. Where there are too many hashes for a filter, rows
are joined with them instead: entries with the wanted grams, and texts with the
wanted places in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_values, merged, mix64, prefix_hash, span_hash, text_buffer, tidy, word_spans

#: Units handled at once; one document may have more, and is then cut into stretches that overlap by a window.
STRETCH = 400_000
_PLACE_BITS = 21  # > log2(STRETCH + a window)
#: Bits of a filter: 2 ** 27, 16 MB.
FILTER_BITS = 27
#: Hashes that a filter is made of at most, a sixteenth of its bits; more are joined instead.
FILTER_ROWS = 1 << (FILTER_BITS - 4)
#: Columns that name a document: its id, and a hash of its text, as ids may repeat.
DOC = ["doc_id", "th"]
#: Columns that name a class: the gram, and a hash of all that its entries have in common.
CLASS = ["gram", "kind"]
#: at: place, hi and lo of an entry in one long.
_FIELD = 16


@dataclass(frozen=True)
class Shape:
    """size: units in a window; gram: units in an anchor's gram; unit: 'byte' or 'word'."""

    size: int
    gram: int
    unit: str

    def __post_init__(self):
        if not 0 < self.gram <= self.size < 1 << _FIELD:
            raise ValueError("a gram must fit a window, and a window 16 bits")


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values: block-wise running minima from both sides meet."""
    n = len(x)
    if w == 1:
        return x
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


@dataclass
class Entries:
    """row: of the batch; place: of the anchor in its document; lo, hi: its windows begin at place - hi .. place - lo; stretch: hash of all they cover; here: place in the stretch at hand."""

    row: np.ndarray
    place: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    stretch: np.ndarray
    here: np.ndarray

    def at(self) -> np.ndarray:
        return self.place << 2 * _FIELD | self.hi << _FIELD | self.lo

    def kind(self) -> np.ndarray:
        return mix64(self.stretch.view(np.uint64) + mix64((self.hi << _FIELD | self.lo).astype(np.uint64))).view(np.int64)


def entries_of(sums: np.ndarray, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray, shape: Shape) -> Entries | None:
    """Entries of stretches that lie one behind the other in sums; before: units of the document before its stretch."""
    n, size, gram = len(sums) - 1, shape.size, shape.gram
    counts = np.maximum(ends - begins - size + 1, 0)
    if n < size or not counts.any():
        return None
    at = np.arange(n - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    packed = hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | at.astype(np.uint64)
    least = sliding_min(packed, size - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    place = least[starts].astype(np.int64)
    change = np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    place, first, last = place[first], starts[first], starts[last]
    owner = np.searchsorted(begins, place, "right") - 1
    # empty stretches share their begin with the next one; searchsorted from the right takes the last, which is the one with units
    return Entries(rows[owner], place - begins[owner] + before[owner], place - last, place - first, hashes[place].view(np.int64), span_hash(sums, first, last + size).view(np.int64), place)


def stretches(column, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(unit values, rows, begins, ends, units before) of an Arrow text column, in bounded portions. Rows without a whole window are left out."""
    data, lo, hi = text_buffer(column)
    step = max(STRETCH, 4 * shape.size)

    def portions(begins: np.ndarray, ends: np.ndarray):
        """Runs of (row, begin, end, before) with about a step of units."""
        run: list[tuple[int, int, int, int]] = []
        held = 0
        for row in np.flatnonzero(ends - begins >= shape.size).tolist():
            b, e = int(begins[row]), int(ends[row])
            for a in range(b, e - shape.size + 1, step - shape.size + 1):
                part = (row, a, min(e, a + step), a - b)
                if run and held + part[2] - a > step:
                    yield run
                    run, held = [], 0
                run.append(part)
                held += part[2] - a
        if run:
            yield run

    if shape.unit == "byte":
        for run in portions(lo, hi):
            r, a, e, before = (np.array(x) for x in zip(*run, strict=True))
            values = np.concatenate([byte_values(data[x:y]) for x, y in zip(a.tolist(), e.tolist(), strict=True)])
            ends = np.cumsum(e - a)
            yield values, r, ends - (e - a), ends, before
        return
    for rows, hashes, firsts in word_hashes(data, lo, hi):
        for run in portions(firsts[:-1], firsts[1:]):
            r, a, e, before = (np.array(x) for x in zip(*run, strict=True))
            values = np.concatenate([hashes[x:y] for x, y in zip(a.tolist(), e.tolist(), strict=True)])
            ends = np.cumsum(e - a)
            yield values, rows[r], ends - (e - a), ends, before


def row_runs(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many bytes; a longer row is a run by itself."""
    begin = held = 0
    for i, n in enumerate((hi - lo).tolist()):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lo):
        yield begin, len(lo)


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hash of every word, first word of each row and the end)."""
    for a, b in row_runs(lo, hi, most):
        starts, ends, firsts = word_spans(data, lo[a:b], hi[a:b])
        base = int(lo[a])
        sums = prefix_hash(byte_values(data[base : int(hi[b - 1])]))
        yield np.arange(a, b), span_hash(sums, starts - base, ends - base), firsts


class Filter:
    """A bitmap of 2 ** FILTER_BITS bits; while few are set it travels as the words that are not zero."""

    def __init__(self, at: np.ndarray, words: np.ndarray):
        self._dense: np.ndarray | None = None
        self._at, self._words = at.astype(np.uint32), words
        if 12 * len(at) >= 8 << (FILTER_BITS - 6):
            self._dense = self.dense()
            self._at, self._words = self._at[:0], self._words[:0]
        self._whole = self._dense is not None

    def __getstate__(self):
        return {**self.__dict__, "_dense": self._dense if self._whole else None}

    def dense(self) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
            self._dense[self._at] = self._words
        return self._dense


def allowed(held: Filter, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    x = h.view(np.uint64)
    return (held.dense()[(x >> np.uint64(70 - FILTER_BITS)).astype(np.intp)] >> ((x >> np.uint64(64 - FILTER_BITS)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame, column: str):
    """A broadcast Filter that lets these hashes through; at most 2 ** (FILTER_BITS - 6) rows come to the driver. destroy() it once what it was used for is written."""
    words = hashes.select(F.shiftrightunsigned(column, 70 - FILTER_BITS).alias("w"), F.shiftrightunsigned(column, 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int").alias("b"))
    table = words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v")).toArrow()
    return hashes.sparkSession.sparkContext.broadcast(Filter(table.column("w").to_numpy(), table.column("v").to_numpy().view(np.uint64)))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _batch_entries(batch, shape: Shape) -> Iterator[tuple[Entries, np.ndarray, np.ndarray]]:
    for values, rows, begins, ends, before in stretches(batch.column("text"), shape):
        sums = prefix_hash(values)
        found = entries_of(sums, rows, begins, ends, before, shape)
        if found is not None:
            yield found, sums, values


def grams(docs: DataFrame, shape: Shape) -> DataFrame:
    """The grams of all anchors: (gram, several); each batch gives a gram once and says whether it has it more than once."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for found, _, _ in _batch_entries(batch, shape):
                g, n = np.unique(found.gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.minimum(n, 2).astype(np.int32))], ["gram", "n"])

    return docs.select("text").mapInArrow(tidy(made), "gram long, n int")


def entries(docs: DataFrame, shape: Shape, bitmap: Broadcast | None) -> DataFrame:
    """All entries whose gram the filter lets through."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for found, _, _ in _batch_entries(batch, shape):
                ok = np.flatnonzero(allowed(bitmap.value, found.gram)) if bitmap else np.arange(len(found.row))
                row = pa.array(found.row[ok])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), *(pa.array(x[ok]) for x in (found.at(), found.gram, found.kind()))], [*DOC, "at", *CLASS])

    return docs.mapInArrow(tidy(made), f"doc_id {kind}, th long, at long, gram long, kind long")


def entries_of_grams(docs: DataFrame, shape: Shape, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries whose gram is wanted (perhaps some more), as the table "entries"."""
    grams = scratch.table("wanted", wanted.select("gram").distinct())
    if grams.count() > FILTER_ROWS:
        found = entries(docs, shape, None)
        out = scratch.table("entries", found.join(merged(grams), "gram", "left_semi").select(found.columns))
    else:
        bitmap = filter_of(grams, "gram")
        out = scratch.table("entries", entries(docs, shape, bitmap))
        bitmap.destroy()
    scratch.drop("wanted")
    return out


def member_hash(th: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of an entry's place, the same wherever it is made."""
    return mix64(th.view(np.uint64) + mix64(at.astype(np.uint64))).view(np.int64)


def member_hashes(members: DataFrame) -> DataFrame:
    """h of each row with th and at."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(member_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["h"])

    return members.select("th", "at").mapInArrow(tidy(made), "h long")


def unpacked(at):
    """place, lo and hi of at: of a column or an array."""
    if isinstance(at, np.ndarray):
        return at >> 2 * _FIELD, at & ((1 << _FIELD) - 1), at >> _FIELD & ((1 << _FIELD) - 1)
    low = F.lit((1 << _FIELD) - 1)
    return F.shiftright(at, 2 * _FIELD), at.bitwiseAND(low), F.shiftright(at, _FIELD).bitwiseAND(low)


def whole_spans(members: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, th, a, b) of all that the windows of entries cover."""
    place, lo, hi = unpacked(F.col("at"))
    return members.select(*DOC, (place - hi).alias("a"), (place - lo + shape.size).alias("b"))


def classes(found: DataFrame) -> DataFrame:
    """Each class with its number of members and its first one (by id, then place), for grams that stand more than once; alone: no other class has the gram."""
    per = found.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*DOC, "at")).alias("first"))
    of_gram = per.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    return per.join(merged(of_gram), "gram").select(*CLASS, "n", "first", (F.col("kinds") == 1).alias("alone"), "kinds")


def members_of(found: DataFrame, kinds: DataFrame, most: int) -> DataFrame:
    """The entries of these classes (gram, kind, n). A class of more than most members would be dealt to one task; as such classes are fewer than one for every most entries, they go to all tasks instead, and their members stay where they are."""
    large, small = F.broadcast(kinds.where(F.col("n") > most).select(*CLASS)), kinds.where(F.col("n") <= most).select(*CLASS)
    return found.join(large, CLASS, "left_semi").unionByName(found.join(large, CLASS, "left_anti").join(merged(small), CLASS, "left_semi"))


def looked_up(docs: DataFrame, wanted: DataFrame, shape: Shape, payload: str, take: Callable) -> tuple[DataFrame, Broadcast | None]:
    """wanted (doc_id, th, at, ...) with payload: take(entries, indices, sums, values) gives an Arrow array. Texts are read again through a filter, which is returned too, and not shuffled; the join removes what else it lets through. Where too many are wanted for a filter, texts are shuffled to their wanted places."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bitmap = filter_of(member_hashes(wanted), "h") if wanted.count() <= FILTER_ROWS else None
    if bitmap is None:
        places = wanted.groupBy(*DOC).agg(F.collect_set("at").alias("places"))
        a, b = docs.alias("a"), places.alias("b")
        docs = a.join(merged(b), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in DOC]).select("a.*", "b.places")

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            if bitmap is None:
                lists = batch.column("places")
                named = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                # a place within its row, as one number each
                held = np.sort(member_hash(named, lists.flatten().to_numpy()))
            for found, sums, values in _batch_entries(batch, shape):
                at = found.at()
                if bitmap is None:
                    h = member_hash(found.row.astype(np.int64), at)
                    ok = np.flatnonzero(held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h)
                else:
                    ok = np.flatnonzero(allowed(bitmap.value, member_hash(batch.column("th").to_numpy()[found.row], at)))
                row = pa.array(found.row[ok])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(at[ok]), take(found, ok, sums, values)], [*DOC, "at", "payload"])

    got = docs.mapInArrow(tidy(made), f"doc_id {kind}, th long, at long, payload {payload}")
    keys = [*DOC, "at"]
    a, b = wanted.alias("a"), got.alias("b")
    return a.join(merged(b), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select("a.*", "b.payload"), bitmap


def whole_groups(batches, least: int):
    """Batches sorted by gram to tables of whole groups of equal grams, with about so many rows or one group."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > least:
            table = pa.Table.from_batches(held)
            column = table.column("gram").to_numpy()
            end = int(np.searchsorted(column, column[-1]))
            if end:
                yield table.slice(0, end).combine_chunks()
                table = table.slice(end)
                held, rows = table.to_batches(), len(table)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, th, a, b) to one row a document with its distinct spans: rows that agree in id and text have the same ones, however many they are."""
    return spans.groupBy(*DOC).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def joined_spans(docs: DataFrame, found: tuple[DataFrame, Broadcast | None], scratch: Scratch) -> DataFrame:
    """docs (doc_id, th, ...) with the spans of each; the spans are written, and what they were made from, with its filter, is dropped."""
    held = scratch.table("spans", spans_by_document(found[0]))
    if found[1]:
        found[1].destroy()
    scratch.drop("entries", "classes", "looked")
    a, b = docs.alias("a"), held.alias("b")
    return a.join(merged(b), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in DOC], "left").select("a.*", "b.spans")


def covered(spans) -> list[tuple[int, int]]:
    """Sorted spans that neither touch nor overlap, with the same units."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
