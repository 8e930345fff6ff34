"""Documents in and out: files, tables, standard input."""

from __future__ import annotations

import hashlib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scratch

FORMATS = ("text", "html", "json")
#: doc_id, format, text.
DOCUMENT_TYPE = "doc_id bigint, format string, text string"


def check_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {name}")
    return name


def from_files(spark: SparkSession, path: str, format_name: str = "text", plain: bool = False) -> DataFrame:
    """A document for each file of a path, folder or pattern: its whole content, its path, and an id from the path. plain: none is compressed, which spares Spark a look for codecs at each file."""
    check_format(format_name)
    held = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value")) if plain else spark.read.text(path, wholetext=True)
    files = held.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), F.lit(format_name).alias("format"), "text", "path")


def from_table(df: DataFrame, id_col: str, text_col: str, format_name: str = "text") -> DataFrame:
    check_format(format_name)
    return df.select(F.col(id_col).alias("doc_id"), F.lit(format_name).alias("format"), F.col(text_col).alias("text"))


def from_text(spark: SparkSession, text: str, format_name: str = "text") -> DataFrame:
    """One document from a string on the driver."""
    return spark.createDataFrame([(0, check_format(format_name), text)], DOCUMENT_TYPE)


def from_stdin(spark: SparkSession, format_name: str = "text", stream=None) -> DataFrame:
    """One document from standard input, read to its end; a terminal is refused."""
    stream = stream or sys.stdin
    if stream.isatty():
        raise ValueError("nothing on standard input: name a file, or pipe a text into it")
    return from_text(spark, stream.read(), format_name)


def split_blank(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with a text that is more than white space, and the others (null texts too)."""
    blank = F.coalesce(tx.is_blank(F.col(text_col)), F.lit(True))
    return docs.where(~blank), docs.where(blank)


def write_prepared(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """What a dry run of a collection prepares: doc_id, prepared and the number of spans of each filter, as JSON lines."""
    df.select("doc_id", "prepared", "filter_stats").write.mode(mode).json(path)


def write(df: DataFrame, path: str, kind: str = "parquet", text_col: str = "result", mode: str = "errorifexists") -> None:
    """Results as Parquet or JSON, or the text column alone, without ids."""
    if kind == "text":
        df.select(text_col).write.mode(mode).text(path, lineSep="\n")
    else:
        df.write.mode(mode).format(kind).save(path)


def write_files(df: DataFrame, path: str) -> None:
    """A file for each row of a single text column, with a line's end, all in a new folder. On a disk that driver and executors share the tasks make them, as Hadoop starts two processes for a file's permissions where it has no native library; in other stores Spark does. Rows of a partition must be the same when it is computed again."""
    folder = scratch.on_disk(df.sparkSession, path)
    if folder is None:
        # tasks move their own files
        return df.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)

    def made(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get(), {}
        for batch in batches:
            for text in batch.column(0):
                raw = (text.as_py() or "").encode() + b"\n"
                # a name by content and number among equals: a second attempt makes the same files, in whatever order rows come
                h = hashlib.sha256(raw).digest()[:16]
                seen[h] = seen.get(h, 0) + 1
                name = f"part-{task.partitionId():05d}-{h.hex()}-{seen[h]}.txt"
                with open(held := f"{folder}/.{name}-{task.taskAttemptId()}", "wb") as f:
                    f.write(raw)
                os.replace(held, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    os.makedirs(folder)
    df.mapInArrow(made, "n long").agg(F.sum("n")).collect()
