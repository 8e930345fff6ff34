"""Running totals, sketches, event time and SQL functions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import spans, sql
from glossaflow.functions import text as tx
from glossaflow.plans import reports
from glossaflow.streaming import stream

KIND = "k string, n long, part int, `within` long"


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_running_total(spark, ranges):
    """A key with half of all rows, nulls, equal rows, clashing names."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "z", None]), rnd.choice([None, 0, 1, 5, 10**12]), i % 3, i) for i in range(500)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = reports.running_total(df, ["k"], F.col("n"), "before", ranges)
    assert got.columns == [*df.columns, "before"]
    got = got.collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(rows, key=repr)
    # each row begins where another ends, in order of the key
    got.sort(key=lambda r: (r.before, (r.n or 0) > 0))
    assert len(got) == len(rows) and got[0].before == 0
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append(r)
    at = 0
    for k in (None, "a", "hot", "z"):
        steps = sorted((r.before, r.n or 0) for r in by_key[k])
        assert steps[0][0] == at
        for before, n in steps:
            assert before == at
            at += n
    assert at == sum(r[1] or 0 for r in rows)


def test_running_total_of_nothing(spark):
    assert reports.running_total(spark.createDataFrame([], KIND), ["k"], F.col("n"), "before").count() == 0


def test_running_total_has_no_task_for_all(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("n"))
    plan = reports.running_total(df, ["k"], F.col("n"), ranges=8)._jdf.queryExecution().executedPlan().toString()
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2 and "sum" in single[0]  # only the sums of ranges


def test_sketches_are_merged(spark):
    """As the same number of rows in one sketch; bounded however many rows there are."""
    df = spark.range(200_000).select((F.col("id") % 7).alias("d"), (F.col("id") % 3).cast("string").alias("s"), F.col("id").alias("item"), (F.col("id") % 1000).alias("amount"))
    kept = reports.usage_sketches(df, F.col("d"), ["s"], F.col("item"), F.col("amount"))
    assert kept.count() == 21 and kept.agg(F.max(F.octet_length("items")), F.max(F.octet_length("amounts"))).first()[0] < 10_000
    made = {(r.s, r.level): r for r in reports.usage_cube(kept, ["s"]).collect()}
    assert set(made) == {("0", 0), ("1", 0), ("2", 0), (None, 1)}
    whole = made[None, 1]
    assert whole.n == 200_000 and whole.total == sum(i % 1000 for i in range(200_000))
    assert abs(whole.n_items - 200_000) < 0.05 * 200_000 and abs(whole.p50 - 500) < 20 and abs(whole.p90 - 900) < 20
    assert reports.usage_cube(reports.usage_sketches(df.where("false"), F.col("d"), ["s"], F.col("item"), F.col("amount")), ["s"]).count() <= 1


def test_late_and_repeated_rows(spark, tmp_path):
    """In batches: an early copy is dropped, one after the time limit counts again, and a row that is too late doesn't."""
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [
        [("a", at(1), "x", 1), ("a", at(1, 20), "x", 1), ("b", at(1, 30), "y", 5)],
        [("a", at(1, 40), "x", 1), ("c", at(2, 10), "x", 2)],
        [("d", at(6), "x", 3)],
        [("late", at(1, 5), "x", 100), ("a", at(6, 30), "x", 7)],
        [("end", at(12), "x", 1)],
    ]
    schema = "id string, ts timestamp, kind string, n long"
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema(schema).parquet(str(source))
        made = stream.usage_windows(stream.asked_once(events, "ts", ["id"], "1 hour"), "ts", ["kind"], F.col("n"))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.start.hour, r.kind): (r.n, r.total) for r in spark.read.schema(made.schema).parquet(out).collect()}
    assert got == {(1, "x"): (1, 1), (1, "y"): (1, 5), (2, "x"): (1, 2), (6, "x"): (2, 10)}


def test_sql_functions_equal_columns(spark):
    names = sql.register(spark, "t_")
    assert "t_segments" in names
    texts = ["", " \t", None, "x http://a.b/c 'q' \"r\" (https://d) ftp://e", '{"a": [1, "b:c"]}', f"pre {tx.START}\n in \n{tx.END} {tx.START}b{tx.END}", "@@0@@ x", "mailto://x é😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df.createOrReplaceTempView("t_texts")
    made = spans.protect(df, "t", spans.resolve(["url"]))
    c = F.col("t")
    want = made.select("i", tx.is_blank(c), tx.wrap(c), tx.unwrap(c), tx.tag_json(c), tx.untag_json(tx.tag_json(c)), spans.holds_marks(c), F.col("spans")[0]["found"], "prepared").orderBy("i").collect()
    got = spark.sql("SELECT i, t_is_blank(t), t_wrap_marks(t), t_unwrap_marks(t), t_tag_json(t), t_untag_json(t_tag_json(t)), t_holds_marks(t), t_addresses(t), t_protect_addresses(t) FROM t_texts ORDER BY i").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    back = spark.sql("SELECT i, t, t_restore_spans(t_protect_addresses(t), t_addresses(t)) AS b FROM t_texts WHERE NOT t_holds_marks(t)").collect()
    assert back and all(r.b == r.t for r in back)
    pieces = spark.sql("SELECT i, pos, segment, address FROM t_texts, LATERAL t_segments(t) ORDER BY i, pos").collect()
    assert [(r.segment, r.address) for r in pieces if r.i == 3] == [("x ", "http://a.b/c"), (" 'q' \"r\" (", "https://d"), (") ", "ftp://e"), ("", None)]
    assert "".join(r.segment + (r.address or "") for r in pieces if r.i == 3) == texts[3]
    plan = spark.sql("SELECT i FROM t_texts WHERE t_is_blank(t)")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (trim(t" in plan and "Python" not in plan
