"""Reports over results of translate(), as ordinary aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def filter_totals(results: DataFrame) -> DataFrame:
    """For each filter: documents with a span, and spans."""
    # the counts stand behind a generator: else their whole computation would be repeated for each of their fields
    once = results.select(F.explode(F.array("filter_stats")).alias("held"))
    each = once.select(F.inline("held"))
    return each.groupBy("filter").agg(F.sum(F.when(F.col("count") > 0, 1).otherwise(0)).cast("bigint").alias("n_docs"), F.sum("count").cast("bigint").alias("n_spans"))


def length_totals(results: DataFrame, *by: str) -> DataFrame:
    """Characters before, prepared and after, with subtotals of by."""
    sums = [F.coalesce(F.sum(f"lengths.{k}"), F.lit(0)).cast("bigint").alias(k) for k in ("original", "prepared", "translated")]
    return results.rollup(*by).agg(F.count(F.lit(1)).alias("n_docs"), *sums)


def usage_totals(results: DataFrame, *by: str) -> DataFrame:
    """Usage of each category and part, by these columns. The total is the part ''."""
    each = results.select(*by, F.explode("consumed").alias("category", "used"))
    parts = F.map_concat(F.create_map(F.lit(""), F.col("used.total")), F.coalesce("used.breakdown", F.create_map().cast("map<string,bigint>")))
    return each.select(*by, "category", F.explode(parts).alias("part", "n")).groupBy(*by, "category", "part").agg(F.sum("n").cast("bigint").alias("n"))


def error_totals(results: DataFrame) -> DataFrame:
    """Documents by the stage and code of their error."""
    # behind a generator: else the filter would be computed anew below the call's and the checks' results, Python functions and all
    once = results.select(F.explode(F.array("error")).alias("error"))
    return once.where("error is not null").groupBy("error.stage", "error.code").agg(F.count(F.lit(1)).alias("n_docs"))


def _padded(name: Column, width: int = 12) -> Column:
    """A name with a capital, a colon, and spaces up to a width."""
    label = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)), F.lit(":"))
    return F.when(F.length(label) < width, F.rpad(label, width, " ")).otherwise(label)


def lines_of(lengths: Column, filter_stats: Column, consumed: Column) -> Column:
    """What a run reports about each document, as text."""
    chars = [F.concat(F.lit("  "), F.rpad(F.lit(f"{k}:"), 12, " "), lengths[k].cast("string")) for k in ("original", "prepared", "translated")]
    spans = F.transform(filter_stats, lambda s: F.concat(F.lit("  "), s["filter"], F.lit(": "), s["count"].cast("string")))
    spans = F.when(F.size(spans) > 0, spans).otherwise(F.array(F.lit("  no filters")))
    number = lambda name, n: F.concat(F.lit("    "), _padded(name), F.lit(" "), F.coalesce(n, F.lit(0)).cast("string"))
    parts = lambda used: F.transform(F.map_entries(F.coalesce(used["breakdown"], F.create_map().cast("map<string,bigint>"))), lambda e: number(e["key"], e["value"]))
    usage = F.flatten(F.transform(F.map_entries(consumed), lambda c: F.concat(F.array(F.concat(F.lit("  "), F.upper(F.substring(c["key"], 1, 1)), F.substr(c["key"], F.lit(2)), F.lit(":")), number(F.lit("total"), c["value"]["total"])), parts(c["value"]))))
    usage = F.when(F.size(usage) > 0, usage).otherwise(F.array(F.lit("  not given")))
    return F.array_join(F.concat(F.array(F.lit("Characters:"), *chars), F.array(F.lit("Spans:")), spans, F.array(F.lit("Usage:")), usage), "\n")


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str = "offset", ranges: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before each, in this order (nulls first, a null value counts nothing); rows that agree in it follow one another by a hash of all columns.

    No task gets all rows: ranges of the order are written to the shared folder, each is
    summed, the sums of the ranges, a row for each, are added up, and within a range the
    rows are. Equal rows of order may be split between ranges, as the hash is part of it.
    """
    spark, columns = df.sparkSession, df.columns
    plain = [F.col(f"`{f.name}`").cast("string") if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{f.name}`") for f in df.schema]
    # the columns of df are apart, so that no name of theirs is in the way
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(value.cast("bigint"), F.lit(0)).alias("value"), F.xxhash64(*plain).alias("tie"))
    keys = [F.col(f"row.`{c}`").asc_nulls_first() for c in order] + [F.col("tie").asc()]
    dealt = held.repartitionByRange(ranges, *keys) if ranges else held.repartitionByRange(*keys)
    path = scratch.temporary(spark, "ranges")
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    sums = held.groupBy("part").agg(F.sum("value").alias("sum"))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumn("within", F.coalesce(F.sum("value").over(within), F.lit(0))).join(F.broadcast(before), "part")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], (F.col("before") + F.col("within")).alias(name))


def usage_sketches(df: DataFrame, day: Column, by: Sequence[str], item: Column, amount: Column, bits: int = 12, k: int = 400) -> DataFrame:
    """day, by, n, total, and two sketches of bounded size: of the distinct items (a standard error of 1.04 / sqrt(2 ** bits): 1.6 %) and of the amounts' ranks (k 400: ranks within 0.7 % or so). Kept by day, they can be merged over days and columns without the rows."""
    held = df.select(day.alias("day"), *by, item.alias("_item"), amount.cast("bigint").alias("_amount"))
    return held.groupBy("day", *by).agg(F.count(F.lit(1)).alias("n"), F.sum("_amount").alias("total"), F.hll_sketch_agg("_item", bits).alias("items"), F.kll_sketch_agg_bigint("_amount", k).alias("amounts"))


def usage_cube(sketches: DataFrame, by: Sequence[str], shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Subtotals over all combinations of by from sketches: n, total, the number of distinct items, and quantiles of the amounts. Only rows of sketches are read, however many rows they stand for."""
    merged = sketches.cube(*by).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_bigint("amounts").alias("amounts"))
    quantiles = [F.kll_sketch_get_quantile_bigint("amounts", F.lit(float(q))).alias(f"p{round(100 * q)}") for q in shares]
    return merged.select(*by, "level", "n", "total", F.hll_sketch_estimate("items").alias("n_items"), *quantiles)
