"""Runs: stretches of words that repeat with a period, by masking and Main–Lorentz.

A run of period q and length l has its first l - q words again q words later,
so each of its words lies in a k-gram that its document holds twice, with k the
least l - q that a run can have. The words outside such k-grams cannot be in a
run, and what is left are short segments in most texts. On these segments alone
the algorithm of Main and Lorentz halves again and again: a run of at least
four periods that crosses a middle has a square that ends or begins there; the
squares are found, and extended to both sides as far as the period holds.

All segments of a batch go through a level of halving together, as arrays.
Stretches are compared by running sums of 64 bits, and every run is held
against the words themselves before it is returned; k-grams are compared by
hashes alone, as one that is taken for repeated only leaves a word in.

A document is one row and is worked on whole; batches are cut by characters, so
memory follows the longest text. Defined results: a null text, an empty one and
one of white space have no words, no runs and an empty collapsed text; a text
without runs collapses to its words joined by spaces; repeated rows give a row
each; other columns are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, mix64, prefix_hash, span_hash, tidy
from .token_counts import slices

RUN = "struct<start: long, length: long, period: long>"


@dataclass(frozen=True)
class Least:
    """A run has at least so many words and so many periods, four or more: so many put two of them on one side of any middle."""

    words: int = 6
    periods: int = 4

    def __post_init__(self):
        if self.periods < 4:
            raise ValueError("runs of less than four periods are not looked for")

    def length(self, period):
        return np.maximum(self.words, self.periods * period)

    @property
    def overlap(self) -> int:
        """The least number of words that a run has again one period later."""
        last = -(-self.words // self.periods)
        return min(max(self.words, self.periods * q) - q for q in range(1, last + 1))


def repeated(ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """For each word whether it lies in a k-gram that its row holds twice (or, rarely, in one that has the hash of another)."""
    n = len(ids) - k + 1
    inside = np.zeros(len(ids), bool)
    if n < 2:
        return inside
    gram = mix64(row[:n].astype(np.uint64) + np.uint64(1))
    for j in range(k):
        gram = (gram + ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(32)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    # what shares its slot with nothing is no repeat; only the rest is sorted
    slots = (gram[at] >> np.uint64(40)).astype(np.int64)
    at = at[np.bincount(slots, minlength=1)[slots] > 1]
    order = at[np.argsort(gram[at], kind="stable")]
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return np.cumsum(edge[:-1]) > 0


def segments(inside: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of marked words within a row, without those that are too short."""
    held = np.concatenate([[False], inside, [False]])
    change = np.concatenate([[True], row[1:] != row[:-1], [True]])
    begin = np.flatnonzero(held[1:] & (~held[:-1] | change))
    end = np.flatnonzero(held[:-1] & (~held[1:] | change))
    begin = begin[begin < len(inside)]
    long = end - begin >= least
    return begin[long], end[long]


def _agree(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and from b on (step 1), or before them (step -1), are equal, at most so many."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        if step > 0:
            same = span_hash(sums, a, a + middle) == span_hash(sums, b, b + middle)
        else:
            same = span_hash(sums, a - middle, a) == span_hash(sums, b - middle, b)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def _crossing(sums, lo, hi, first, last, least: Least):
    """The runs that cross the middles of nodes lo..hi, extended within first..last: begin, end, period."""
    middle = (lo + hi) // 2
    most = (hi - lo) // least.periods
    node = np.repeat(np.arange(len(lo)), most)
    period = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
    m, a, b = middle[node], first[node], last[node]
    out = []
    for side in (-1, 1):
        # a square that ends at the middle, or begins there
        x = m - 2 * period if side < 0 else m
        ok = (x >= a) & (x + 2 * period <= b)
        ok[ok] = span_hash(sums, x[ok], (x + period)[ok]) == span_hash(sums, (x + period)[ok], (x + 2 * period)[ok])
        x, q, f, l, of = x[ok], period[ok], a[ok], b[ok], node[ok]
        # a node's least period first: multiples of it within its run are the same run
        while len(x):
            least_one = np.concatenate([[True], of[1:] != of[:-1]])
            y, p = x[least_one], q[least_one]
            begin = y - _agree(sums, y, y + p, y - f[least_one], -1)
            end = y + 2 * p + _agree(sums, y + p, y + 2 * p, l[least_one] - y - 2 * p, 1)
            long = end - begin >= least.length(p)
            out.append((begin[long], end[long], p[long]))
            at = np.cumsum(least_one) - 1
            rest = (q % p[at] != 0) | (x < begin[at]) | (x + 2 * q > end[at])
            x, q, f, l, of = x[rest], q[rest], f[rest], l[rest], of[rest]
    if not out:
        return [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _plainly(ids: np.ndarray, first: int, last: int, q: int, least: Least) -> list[tuple[int, int, int]]:
    """The runs of a period in a segment by comparing its words one by one."""
    same = np.concatenate([[False], ids[first : last - q] == ids[first + q : last], [False]])
    begin, end = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    return [(first + a, first + b + q, q) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a + q >= least.length(q)]


def runs_of(ids: np.ndarray, row: np.ndarray, least: Least = Least()) -> np.ndarray:
    """All runs within rows: begin, end and smallest period of each, by begin and period. Words are equal where ids are."""
    none = np.zeros((0, 3), np.int64)
    if len(ids) < least.words:
        return none
    first, last = segments(repeated(ids, row, least.overlap), row, least.words)
    if not len(first):
        return none
    sums = prefix_hash(mix64(ids.astype(np.uint64) + np.uint64(1)))
    lo, hi, found = first, last, []
    while len(lo):
        found.append(np.stack(_crossing(sums, lo, hi, first, last, least), 1))
        middle = (lo + hi) // 2
        lo, hi, first, last = np.concatenate([lo, middle]), np.concatenate([middle, hi]), np.tile(first, 2), np.tile(last, 2)
        on = hi - lo >= least.words
        lo, hi, first, last = lo[on], hi[on], first[on], last[on]
    every = np.unique(np.concatenate(found), axis=0)
    # a run is found by multiples of its period too: of one stretch the least counts
    every = every[np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)])[: len(every)]]
    out = []
    begins, ends = segments(np.ones(len(ids), bool), row, 1)
    for a, b, q in every.tolist():
        if np.array_equal(ids[a : b - q], ids[a + q : b]):
            out.append((a, b, q))
        else:  # two stretches with one hash
            i = np.searchsorted(begins, a, "right") - 1
            out += [x for x in _plainly(ids, begins[i], ends[i], q, least) if x[0] < b and x[1] > a]
    found = np.unique(np.array(out, np.int64).reshape(-1, 3), axis=0)
    # what was found word by word may be a run of a lesser period too
    found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])[: len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def words_of(texts) -> tuple:
    """The words of an Arrow array of texts, and the row of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    row = pc.list_parent_indices(lists).to_numpy()
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(full), row[full.to_numpy(zero_copy_only=False)]


def _slice(texts, least: Least):
    """For an Arrow array of texts: each row's runs and collapsed text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(texts)
    words, row = words_of(texts)
    coded = words.dictionary_encode()
    found = runs_of(coded.indices.to_numpy().astype(np.int64), row, least)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    first = np.searchsorted(row, np.arange(n + 1))
    of = row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    parts = pa.StructArray.from_arrays([pa.array(found[:, 0] - first[of]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), parts)
    left = words.filter(pa.array(keep))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[keep], np.arange(n + 1)), pa.int32()), left)
    return runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def with_runs(docs: DataFrame, least: Least = Least(), id_col: str = "doc_id", text_col: str = "text", most: int = 2_000_000) -> DataFrame:
    """doc_id, runs (start and length in words, smallest period; by start and period) and collapsed: the words, joined by spaces, without those that any run holds after its first period."""

    def run(batches: Iterator):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column(1)
            for s in slices([x or "" for x in texts.to_pylist()], most):
                runs, collapsed = _slice(texts.slice(s.start, s.stop - s.start), least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), runs.cast(kind), collapsed], ["doc_id", "runs", "collapsed"])

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(tidy(run), f"doc_id {held.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed string")


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; in one of ten texts, by a hash of the id, the words from some place on become periodic. A null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    held = barrier(held, words=words)
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    held = held.withColumns({"a": F.when(n > 0, g % n).cast("int"), "p": F.when(n > 0, 1 + F.floor((n - g % n) / (3 + g % 8))).cast("int")})
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return held.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines: Column = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    held = barrier(found, best=best)
    length, period = F.col("best.length"), -F.col("best.period")
    return held.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
