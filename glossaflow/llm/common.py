"""What several operators share: scratch tables on shared storage, and batches of text as arrays."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder, shared_dir  # noqa: F401

#: Characters that separate words: the space and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"


class Scratch:
    """Parquet tables of one run in the shared folder. A table cuts the lineage: its rows stay as they are when executors are lost."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top = spark, folder(spark, what)
        atexit.register(self._delete, self.top)

    def table(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Only for tables of which no returned plan reads any more. Lets Spark remove the shuffle files of finished plans too, which it does when the driver collects its garbage."""
        for name in names:
            self._delete(f"{self.top}/{name}")
        gc.collect()
        _release()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  at exit the gateway may be gone; the folder is temporary anyway
            pass


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged, whatever Spark takes its size to be. A written table counts by its compressed file, and rows of an explode or of collected lists by those before it or by one entry: left to itself, Spark may send to the driver what is many times its limit for that."""
    return df.hint("merge")


def barrier(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are computed once: a generator stands between them and their users, and Spark doesn't inline across it."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made")
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, made).select(*kept, *[F.col(f"_made.{k}").alias(k) for k in columns])


@dataclass(frozen=True)
class Bounds:
    """Ascending rows of columns that part a table into ranges; a literal of a plan."""

    held: tuple[str, ...]
    kind: str
    names: tuple[str, ...]

    @property
    def n(self) -> int:
        return len(self.held)

    def rows(self) -> list[Column]:
        """Each bound as a literal row."""
        return [F.from_json(F.lit(x), self.kind) for x in self.held]

    def below(self, values: list[Column]) -> Column:
        """How many bounds are at most the values (nulls come first), by halving."""
        if not self.n:
            return F.lit(0)
        bounds = F.from_json(F.lit(f"[{','.join(self.held)}]"), f"array<{self.kind}>")
        row = F.struct(*[v.alias(c) for c, v in zip(self.names, values, strict=True)])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(self.n.bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= self.n) & (F.get(bounds, at + step - 1) <= row), at + step).otherwise(at))


def range_bounds(df: DataFrame, columns: list[str], rows_in_range: int, most: int, per_range: int = 64, most_sampled: int = 1_000_000) -> Bounds:
    """Bounds of ranges with about rows_in_range rows each, or as many as most ranges have, from a sample by hash of about per_range rows a range, but eight a range or most_sampled in all: the driver gets that many rows of these columns. The sample decides the sizes of ranges only."""
    kind = df.select(*columns).schema.simpleString()
    n = df.count()
    ranges = min(most, -(-n // rows_in_range))
    if ranges < 2:
        return Bounds((), kind, tuple(columns))
    share = min(1.0, ranges * max(8, min(per_range, most_sampled // ranges)) / n)
    held = df.select(*columns).where(F.shiftrightunsigned(F.xxhash64(*columns, F.lit("ranges")), 1) <= int(2**63 * share) - 1)
    lines = [r[0] for r in held.orderBy(*[F.col(c).asc_nulls_first() for c in columns]).select(F.to_json(F.struct(*columns))).collect()]
    cuts = dict.fromkeys(lines[len(lines) * i // ranges] for i in range(1, ranges)) if lines else ()
    return Bounds(tuple(cuts), kind, tuple(columns))


def tidy(function: Callable) -> Callable:
    """A function for mapInArrow that gives memory back at its end: Spark keeps its Python workers, and what they have freed would stay theirs."""

    def run(batches):
        yield from function(batches)
        _release()

    return run


def _release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffer(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column (null: empty), with each row's begin and end."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held, at[:-1], at[1:]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit, in place where it can."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x5851F42D4C957F2D
_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = -(-n // 65536) * 65536
            up, down = np.full(n, BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values; span_hash() takes spans from them."""
    up, _ = POWERS.to(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[begin:end], the same wherever the span stands."""
    _, down = POWERS.to(len(sums))
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[ord(c) for c in WORD_BREAKS]] = True


def word_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word of a batch, and for each row the number of words before it (one more entry at the end). Rows must lie one behind the other."""
    if not len(begins) or ends[-1] == begins[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(begins) + 1, np.int64)
    lo, hi = int(begins[0]), int(ends[-1])
    inside = ~_IS_BREAK[data[lo:hi]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = begins[(begins > lo) & (begins < hi)] - lo
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1
    return start, end, np.concatenate([np.searchsorted(start, begins), [len(start)]])
