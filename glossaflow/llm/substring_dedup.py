"""Substring dedup with a log-structured fingerprint index.

The index is a list of runs: immutable tables of the fingerprints of batches,
dealt into the same buckets and sorted by fingerprint. A new batch is
merge-joined with every run, bucket by bucket, without a shuffle of the runs;
what is found there, or twice in the batch, is a candidate; then the batch
becomes a run of its own, and when there are more than ``most_runs`` they are
compacted to one before the next batch comes. The fingerprints are the grams of
anchors (see ``windows``), so the index holds one for about every eight words
and none of the texts. An index in a folder is kept, and a later call dedups
new documents against those before them.

Candidates are verified by reading the texts again: entries with a candidate
gram are compared by a hash of their whole stretch, and where stretches differ,
by hashes of their windows, and the earliest window of each word sequence stays.
Hashes have 64 bits and are only compared within a gram (which is a hash of 64
bits itself) and at the same place of the gram, so two different windows are
taken for one with a probability of 2 ** -64 for each pair of one gram. Groups
of more than ``most`` different stretches are not gathered in one task: their
windows are compared in a shuffle.

Defined results: null and empty texts, and texts of fewer words than a window,
lose nothing; the order is by id, nulls first, then by the place in the
document; rows that agree in id and text are one document, and each gets its
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows
from .common import WORD_BREAKS, Scratch, range_bounds, tidy
from .windows import CLASS, DOC, Shape

DEFAULT = Shape(20, 5, "word")


class FingerprintIndex:
    """Runs of fingerprints in shared storage. add() takes a batch and gives the fingerprints that stand more than once so far and stand in the batch. folder: where runs are kept for later calls; without it they are scratch."""

    def __init__(self, spark: SparkSession, scratch: Scratch, shape: Shape = DEFAULT, most_runs: int = 3, folder: str | None = None):
        self.spark, self.scratch, self.shape, self.most_runs, self.folder = spark, scratch, shape, most_runs, folder
        self.top = folder.rstrip("/") if folder else f"{scratch.top}/index"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.made = self.state = 0
        if folder:
            state = self._read_state()
            kept = {"size": shape.size, "gram": shape.gram, "unit": shape.unit}
            if state and state["shape"] != kept:
                raise ValueError("the index is one of other windows")
            self.runs, self.made, self.buckets = state.get("runs", []), state.get("made", 0), state.get("buckets", self.buckets)

    def _files(self):
        """The folder's file system and path, and the names in it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.top)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, jvm.org.apache.hadoop.fs.Path, [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _read_state(self) -> dict:
        """The last state; an error where it cannot be read, where runs that it names are lost, or where there are runs and no state says which of them count. The state before the last is kept beside it."""
        _, _, names = self._files()
        states = [int(m[1]) for n in names if (m := re.fullmatch(r"state-(\d+)\.json", n))]
        if not states:
            if any(n.startswith("run") for n in names):
                raise LookupError(f"the index in {self.top} has runs but no state: which of them count is not known")
            return {}
        self.state = max(states)
        held = self.spark.read.text(f"{self.top}/state-{self.state}.json", wholetext=True).first()
        try:
            state = json.loads(held[0] if held else "")
        except ValueError as e:
            raise LookupError(f"the state state-{self.state}.json of the index in {self.top} cannot be read") from e
        if lost := [run for run in state["runs"] if run not in names]:
            raise LookupError(f"the index in {self.top} has lost its runs {', '.join(lost)}")
        return state

    def commit(self) -> None:
        """Says in the folder which runs count; runs that a failed call has left are not among them. A state is written beside the last one and then renamed, so that a whole one is there at any time."""
        if not self.folder:
            return
        fs, path, names = self._files()
        held = json.dumps({"runs": self.runs, "made": self.made, "buckets": self.buckets, "shape": {"size": self.shape.size, "gram": self.shape.gram, "unit": self.shape.unit}})
        self.state += 1
        fresh = path(f"{self.top}/_state-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(held.encode()))
        out.close()
        if not fs.rename(fresh, path(f"{self.top}/state-{self.state}.json")):
            raise OSError(f"the state of the index in {self.top} could not be renamed: another call may have written it")
        for n in names:
            if (m := re.fullmatch(r"state-(\d+)\.json", n)) and int(m[1]) < self.state - 1:
                fs.delete(path(f"{self.top}/{n}"), False)

    def _table(self, run: str) -> str:
        """The catalog's name of a run: only tables of the catalog have buckets."""
        name = f"fingerprints_{hashlib.sha256(f'{self.top}/{run}'.encode()).hexdigest()[:32]}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (gram BIGINT, n INT) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {self.buckets} BUCKETS LOCATION '{self.top}/{run}'")
        return name

    def run(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def _write(self, grams: DataFrame) -> str:
        """A new run of (gram, n), in which each gram is once."""
        self.made += 1
        # also apart from runs that a failed call may have left in the folder
        run = f"run{self.made}-{uuid.uuid4().hex[:8]}"
        self._table(run)
        # dealt once, as the buckets are, so that each bucket is one sorted file
        once = grams.repartition(self.buckets, "gram").groupBy("gram").agg(F.sum("n").alias("n"))
        once.select("gram", F.least("n", F.lit(2)).cast("int").alias("n")).write.insertInto(self._table(run))
        return run

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: doc_id, th, text."""
        if len(self.runs) >= self.most_runs:
            self.compact()
        fresh = self._write(windows.grams(batch, self.shape))
        # what stands twice in the batch, or once and in an older run
        hits = [self.run(fresh).where("n > 1").select("gram")]
        hits += [self.run(fresh).where("n = 1").select("gram").join(self.run(old).select("gram").hint("merge"), "gram", "left_semi") for old in self.runs]
        found = self.scratch.table(f"hits{self.made}", reduce(DataFrame.unionByName, hits))
        self.runs.append(fresh)
        return found

    def compact(self) -> None:
        """One run in place of all, as if there had been one batch."""
        old = self.runs
        self.runs = [self._write(reduce(DataFrame.unionByName, [self.run(x) for x in old]))]
        self.commit()
        self.drop(old)

    def drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
            self.scratch._delete(f"{self.top}/{run}")

    def close(self) -> None:
        """Keeps the runs in the folder, or without one drops them. The catalog forgets them either way."""
        if self.folder:
            self.commit()
            for run in self.runs:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        else:
            self.drop(self.runs)
            self.scratch.drop()


def batches_by_id(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs in n parts of consecutive ids of any kind (null ids in the first), with about as many rows each."""
    if n < 2:
        return [docs]
    edges = [None, *(x["doc_id"] for x in range_bounds(docs, ["doc_id"], 1, n, 1_000).rows()), None]
    parts = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        keep = F.lit(True) if lo is None else F.col("doc_id") >= lo
        keep = keep & (F.col("doc_id") < hi) if hi is not None else keep
        parts.append(docs.where(keep | F.col("doc_id").isNull() if lo is None else keep))
    return parts


def repeated_spans(docs: DataFrame, candidates: DataFrame, shape: Shape, scratch: Scratch, most: int = 20_000) -> tuple[DataFrame, Broadcast | None]:
    """(doc_id, th, a, b): words a to b of windows that stand earlier. docs: doc_id, th, text. And the filter that they still need, if any."""
    found = windows.entries_of_grams(docs, shape, candidates, scratch)
    kinds = scratch.table("classes", windows.classes(found))
    scratch.drop()
    # all members of a class but the first: each of their windows stands earlier
    later = found.join(kinds.where("n > 1").select(*CLASS, "first"), CLASS)
    whole = windows.whole_spans(later.where(~F.struct(*DOC, "at").eqNullSafe(F.col("first"))), shape)
    # the first members, where other classes have the gram: window by window
    wanted = kinds.where("not alone").select("gram", *[F.col(f"first.{c}").alias(c) for c in [*DOC, "at"]], "kinds")

    def window_hashes(e, ok, sums, values):
        import pyarrow as pa

        n = (e.hi - e.lo + 1)[ok]
        ends = np.cumsum(n)
        starts = np.repeat(e.here[ok] - e.hi[ok] - (ends - n), n) + np.arange(n.sum())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(windows.span_hash(sums, starts, starts + shape.size).view(np.int64)))

    looked, bitmap = windows.looked_up(docs, wanted, shape, "array<long>", window_hashes)
    if kinds.where(F.col("kinds") > most).isEmpty():
        return whole.unionByName(_grouped_windows(looked, shape)), bitmap
    # written, as groups of both sizes need it and the texts are to be read once
    looked = scratch.table("looked", looked)
    small, large = looked.where(F.col("kinds") <= most), looked.where(F.col("kinds") > most)
    return whole.unionByName(_grouped_windows(small, shape)).unionByName(_counted_windows(large, shape)), bitmap


def _grouped_windows(looked: DataFrame, shape: Shape) -> DataFrame:
    """Spans of windows that stand earlier in another row of their gram, all rows of a gram in one task. looked: gram, DOC, at, payload (hashes of the row's windows)."""
    kind = looked.schema["doc_id"].dataType.simpleString()

    def made(batches):
        import pyarrow as pa

        for table in windows.whole_groups(batches, 10_000):  # rows of a gram in their order
            place, _, hi = windows.unpacked(table.column("at").to_numpy())
            lists = table.column("payload").combine_chunks()
            n = np.diff(lists.offsets.to_numpy())
            hashes = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            back = hi[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            grams = table.column("gram").to_numpy()[row]
            order = np.lexsort((hashes, back, grams))  # stable: equal windows stay in the order of their rows
            a, b = order[1:], order[:-1]
            again = np.zeros(len(row) + 2, bool)
            again[1 + a[(hashes[a] == hashes[b]) & (back[a] == back[b]) & (grams[a] == grams[b])]] = True
            # runs within a row
            fresh = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            starts = np.flatnonzero(again[1:-1] & (~again[:-2] | fresh))
            ends = np.flatnonzero(again[1:-1] & (~again[2:] | np.append(fresh[1:], True)))
            at = row[starts]
            yield pa.RecordBatch.from_arrays([*(table.column(c).take(pa.array(at)).combine_chunks() for c in DOC), pa.array(place[at] - back[starts]), pa.array(place[at] - back[ends] + shape.size)], [*DOC, "a", "b"])

    dealt = looked.select("gram", *DOC, "at", "payload").repartition("gram").sortWithinPartitions("gram", F.col("doc_id").asc_nulls_first(), "th", "at")
    return dealt.mapInArrow(tidy(made), f"doc_id {kind}, th long, a long, b long")


def _counted_windows(looked: DataFrame, shape: Shape) -> DataFrame:
    """The same for groups of any size: window by window in shuffles with partial aggregation."""
    place, _, hi = windows.unpacked(F.col("at"))
    # the i-th window begins hi - i units before the anchor
    each = looked.select("gram", *DOC, "at", F.posexplode("payload").alias("i", "w")).select("gram", *DOC, (place - hi + F.col("i")).alias("a"), (hi - F.col("i")).cast("int").alias("l"), "w")
    key = ["gram", "l", "w"]
    firsts = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*DOC, "a")).alias("first")).where("n > 1")
    again = each.join(firsts.select(*key, "first"), key).where(~F.struct(*DOC, "a").eqNullSafe(F.col("first")))
    return again.select(*DOC, "a", (F.col("a") + shape.size).alias("b"))


def remove_words(docs: DataFrame, spans: tuple[DataFrame, Broadcast | None], scratch: Scratch, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words, joined by a space)."""

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, held in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                for c in WORD_BREAKS[1:]:
                    text = text.replace(c, " ")
                words = [w for w in text.split(" ") if w]
                total, n = len(words), 0
                for a, b in reversed(windows.covered((x["a"], x["b"]) for x in held or ())):
                    del words[a:b]
                    n += b - a
                left = " ".join(words)
                out.append((total, n, hashlib.sha256(left.encode()).hexdigest(), left))
            columns = [pa.array(x) for x in list(zip(*out, strict=True))[: 3 + with_text]] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string())][: 3 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return windows.joined_spans(docs, spans, scratch).select("doc_id", "text", "spans").mapInArrow(tidy(kept), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def dedup(docs: DataFrame, shape: Shape = DEFAULT, batches: int = 5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most: int = 20_000, history: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """The documents without words of windows that stand earlier, the index filled batch by batch in the order of ids. With a folder the index in it goes on, and stays there: history are the documents that it has seen, whose ids must come before the new ones."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = windows.named(docs, id_col, text_col)
    index = FingerprintIndex(spark, scratch, shape, folder=folder)
    candidates = reduce(DataFrame.unionByName, [index.add(b) for b in batches_by_id(docs, batches)])
    index.close()
    every = docs if history is None else docs.unionByName(windows.named(history, id_col, text_col))
    return remove_words(docs, repeated_spans(every, candidates, shape, scratch, most), scratch, with_text)
