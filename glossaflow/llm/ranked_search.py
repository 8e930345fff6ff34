"""Ranked lexical search by trees of maxima over ranges of documents.

Documents are read once, in ranges of some thousands: what a range keeps is a
row with its ids, the lengths of its documents, and for each term asked for the
documents that hold it and how often. From the whole table come the number of
documents, of terms and the weights. Over a range every term has a tree: the
most that it adds to a score within 64 documents, within 8 such blocks, and so
on to the range. Summed over an item's terms, a node's maxima bound all scores
below it. Nodes are opened best first from a heap; a leaf is scored; the search
ends at the first bound under the score of the item's last rank, and equal
bounds are opened too, as ties go by id.

Ranges are the upper nodes of the same tree: first each item's best range is
searched, which tells what score its ranks need at least; then every range
whose bound reaches that is, and the best of all ranges are ranked.

Items are asked in blocks of bounded numbers of items and terms; each block is
one pass over the documents.

Defined results: null and empty texts have no terms, are found by no item and
count for nothing; items without terms, or whose terms add nothing, have no
rows; items with the same id and text are one, with different texts each is
ranked; repeated documents take a rank each; a null id comes before others; very
long texts are read whole; columns other than id and text are ignored, whatever
their names; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_buffer, tidy

#: What separates terms, and the constants of weights and scores.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT, SCALE, TF, LENGTH, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 12, 75, 25

LEAF, FAN = 64, 8
RANGE_TYPE = "shard long, n_docs long, n_terms long, term array<int>, docs array<int>, n array<long>, at array<int>, tf array<int>"

_FOLD = np.full(256, ord(" "), np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def terms_of(text: str | None) -> list[str]:
    """The terms of one text: stretches of digits, ASCII letters in lower case, and all characters beyond ASCII."""
    return [x.decode() for x in (text or "").encode().translate(_FOLD.tobytes()).split()]


def postings(texts, known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over an Arrow array of texts: the number of terms of each, and ascending by row: row, place in known, and how often, of the terms that known holds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, begins, ends = text_buffer(texts)
    offsets = np.append(begins, ends[-1:]) if len(begins) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    folded = _FOLD[data[lo:hi]]
    strings = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer((offsets - lo).tobytes()), pa.py_buffer(folded.tobytes()))
    lists = pc.ascii_split_whitespace(strings)
    row, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    row, place = row[full.to_numpy(zero_copy_only=False)], pc.fill_null(pc.index_in(words.filter(full), value_set=known), -1).to_numpy()
    n = np.bincount(row, minlength=len(begins))
    held = place >= 0
    pair, tf = np.unique(row[held].astype(np.int64) * len(known) + place[held], return_counts=True)
    return n, pair // max(len(known), 1), pair % max(len(known), 1), tf


def _slices(texts, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many bytes."""
    _, begins, ends = text_buffer(texts)
    first = 0
    for i in range(len(begins)):
        if i > first and ends[i] - begins[first] > most:
            yield first, i
            first = i
    if first < len(begins):
        yield first, len(begins)


def ranges_of(docs: DataFrame, terms, most_rows: int, most_postings: int) -> DataFrame:
    """A row for each range of documents: its number, documents and terms in all, terms asked for with their numbers of documents, ids, lengths, and the postings by term and place. terms: a broadcast list."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        known = pa.array(terms.value, pa.large_string())
        held: list = []
        rows = size = 0

        def flushed():
            nonlocal held, rows, size, made
            first = np.cumsum([0, *[len(x[1]) for x in held]])
            n = np.concatenate([x[1] for x in held])
            at = np.concatenate([x[2] + f for x, f in zip(held, first, strict=False)])
            place, tf = (np.concatenate([x[k] for x in held]) for k in (3, 4))
            order = np.argsort(place, kind="stable")
            term, docs_of = np.unique(place, return_counts=True)
            one = lambda x, t: pa.array([x], pa.list_(t))
            ids = pa.concat_arrays([x[0] for x in held])
            number = (task << 32) + made
            out = [pa.array([number]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), one(term, pa.int32()), one(docs_of, pa.int32()), one(n, pa.int64()), one(at[order], pa.int32()), one(tf[order], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            held, rows, size, made = [], 0, 0, made + 1
            return pa.RecordBatch.from_arrays(out, ["shard", "n_docs", "n_terms", "term", "docs", "n", "at", "tf", "ids"])

        for batch in batches:
            for a, b in _slices(batch.column(1), 4_000_000):
                for i in range(a, b, most_rows):
                    k = min(b, i + most_rows) - i
                    if held and rows + k > most_rows:
                        yield flushed()
                    found = postings(batch.column(1).slice(i, k), known)
                    held.append((batch.column(0).slice(i, k), *found))
                    rows, size = rows + k, size + len(found[1])
                    if size >= most_postings:
                        yield flushed()
        if held:
            yield flushed()

    return docs.mapInArrow(tidy(run), f"{RANGE_TYPE}, ids array<{kind}>")


class Range:
    """One range of documents with its trees."""

    def __init__(self, term, docs, n, at, tf, weights: np.ndarray, n_docs: int, n_terms: int):
        m = np.array([FLAT + (SLOPE * x * n_docs) // n_terms for x in n.tolist()], np.int64)
        of = np.repeat(np.arange(len(term)), docs)
        tf = tf.astype(np.int64)
        self.at, self.adds = at.astype(np.int64), weights[term[of]] * ((SCALE * tf) // (TF * tf + LENGTH * m[at]))
        blocks = -(-len(n) // LEAF)
        self.size = FAN ** max(0, math.ceil(math.log(max(blocks, 1), FAN) - 1e-9))
        node = of * self.size + self.at // LEAF
        leaves = np.zeros((len(term), self.size), np.int64)
        if len(node):
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            leaves.reshape(-1)[node[first]] = np.maximum.reduceat(self.adds, first)
        self.begin = np.searchsorted(node, np.arange(len(term) * self.size + 1))
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(self.levels[-1].reshape(len(term), -1, FAN).max(2))
        self.place = {t: i for i, t in enumerate(term.tolist())}

    def asked(self, item: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of an item's terms here, and how often it names them."""
        held = [(self.place[t], c) for t, c in item.items() if t in self.place]
        return np.array([x for x, _ in held], np.int64), np.array([c for _, c in held], np.int64)

    def bound(self, rows: np.ndarray, often: np.ndarray) -> int:
        return int(often @ self.levels[-1][rows, 0]) if len(rows) else 0

    def leaf(self, rows: np.ndarray, often: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a leaf that hold any of the terms, and their scores."""
        cell = rows * self.size + block
        begin, count = self.begin[cell], self.begin[cell + 1] - self.begin[cell]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        scores = np.zeros(LEAF, np.int64)
        np.add.at(scores, self.at[at] % LEAF, self.adds[at] * np.repeat(often, count))
        found = np.flatnonzero(scores)
        return found + block * LEAF, scores[found]

    def search(self, item: dict[int, int], k: int, least: int, key) -> list[tuple[int, int]]:
        """(score, place) of the k best with a score of least or more; equal ones by key(place)."""
        rows, often = self.asked(item)
        top = len(self.levels) - 1
        heap = [(-self.bound(rows, often), top, 0)]
        best: list[tuple[int, int]] = []
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < least or not bound:
                break
            if level:
                below = often @ self.levels[level - 1][rows, node * FAN : (node + 1) * FAN]
                for i in np.flatnonzero(below >= least).tolist():
                    heapq.heappush(heap, (-int(below[i]), level - 1, node * FAN + i))
                continue
            at, scores = self.leaf(rows, often, node)
            good = scores >= least
            best += zip(scores[good].tolist(), at[good].tolist(), strict=True)
            if len(best) >= k:
                best = sorted(best, key=lambda x: (-x[0], key(x[1])))[:k]
                least = max(least, best[-1][0])
        return sorted(best, key=lambda x: (-x[0], key(x[1])))[:k]


def _opened(batch, i: int, weights: np.ndarray, n_docs: int, n_terms: int) -> Range:
    get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    return Range(*[get(c) for c in ("term", "docs", "n", "at", "tf")], weights, n_docs, n_terms)


def _block(docs: DataFrame, items: list[tuple], k: int, most_rows: int, most_postings: int, scratch: Scratch, name: str) -> DataFrame | None:
    """number (of the item), doc_id, score: candidates that hold the k best of each item."""
    spark = docs.sparkSession
    terms = sorted({t for _, held in items for t in held})
    place = {t: i for i, t in enumerate(terms)}
    asked = spark.sparkContext.broadcast([{place[t]: c for t, c in held.items()} for _, held in items])
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = scratch.table(name, ranges_of(docs, spark.sparkContext.broadcast(terms), most_rows, most_postings))
    n_docs, n_terms = held.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(terms), np.int64)
    for t, n in held.select(F.explode(F.arrays_zip("term", "docs")).alias("x")).groupBy("x.term").agg(F.sum("x.docs")).collect():
        weights[t] = math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * n + 1)))
    shared = spark.sparkContext.broadcast(weights)

    def bounds(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                one = _opened(batch, i, shared.value, n_docs, n_terms)
                made = [(j, b) for j, item in enumerate(asked.value) if (b := one.bound(*one.asked(item)))]
                yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in made], pa.int32()), pa.array([b for _, b in made], pa.int64()), pa.array([batch.column("shard")[i].as_py()] * len(made), pa.int64())], ["number", "bound", "shard"])

    def searched(which):
        """which(shard): the numbers of items to search there, each with the least score that counts."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(len(batch)):
                    wanted = which(batch.column("shard")[i].as_py())
                    ids = batch.column("ids")[i].values
                    one = _opened(batch, i, shared.value, n_docs, n_terms) if wanted else None
                    key = lambda at: (ids[at].is_valid, ids[at].as_py() if ids[at].is_valid else 0)  # noqa: E731, B023
                    made = [(j, s, at) for j, least in wanted for s, at in one.search(asked.value[j], k, least, key)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), ids.take(pa.array([x[2] for x in made], pa.int64())), pa.array([x[1] for x in made], pa.int64())], ["number", "doc_id", "score"])

        return tidy(run)

    columns = held.drop("n_docs", "n_terms")
    best = columns.mapInArrow(tidy(bounds), "number int, bound long, shard long").groupBy("number").agg(F.max_by("shard", "bound").alias("shard")).collect()
    first: dict[int, list[tuple[int, int]]] = {}
    for r in best:
        first.setdefault(r.shard, []).append((r.number, 1))
    found_type = f"number int, doc_id {kind}, score long"
    seeds = columns.where(F.col("shard").isin(list(first))).mapInArrow(searched(lambda shard: first.get(shard, [])), found_type)
    ranked = Window.partitionBy("number").orderBy(F.desc("score"))
    least = {r.number: r.score for r in seeds.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).collect()}
    every = [(j, least.get(j, 1)) for j in range(len(items))]
    return columns.mapInArrow(searched(lambda shard: every), found_type)


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_items: int = 4096, most_terms: int = 65_536, most_rows: int = 4096, most_postings: int = 1_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0. most_items and most_terms bound a block of items, most_rows and most_postings a range of documents."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    item_kind = items.schema["item_id"].dataType.simpleString()
    n, letters = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-2 * n // most_items), -(-letters // most_terms))  # every second character at most begins a term
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if n else []
        block = [(r.item_id, held) for r in rows if (held := Counter(terms_of(r.text)))]
        found = _block(docs, block, k, most_rows, most_postings, scratch, f"ranges{b}") if block else None
        if found is None:
            continue
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(j, x) for j, (x, _) in enumerate(block)], f"number int, item_id {item_kind}")
        part = best.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return out
