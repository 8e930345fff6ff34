"""Queries over tables of other shapes than the small ones': folders of files, pages that break off."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glossaflow.functions import validation
from glossaflow.plans.catalog import ORACLES, QUERIES
from glossaflow.sources import documents

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name: str, sf_dir: str, table: str) -> int:
    """The number of rows, which are those of the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
    return len(want)


@pytest.mark.parametrize("name, table", [("stream_protect", "pages"), ("stream_job", "events"), ("stream_windows", "events")])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name, table):
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert same_as_sql(spark, name, str(tmp_path), table) > 0


def test_pages_with_cut_titles(spark, tmp_path):
    """A title cut within a character reference is an error of the page; the query is about the article and hands the checker whole references."""
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>a &amp; b &#38;</p></article></body></html>"
    cut = ["a &", "a &a", "a &am", "a &amp", "a &amp;", "a &#3", "a &#38;"]
    assert [bool(validation.html_errors(page.format(x))) for x in cut] == [True, True, True, True, False, True, False]
    spark.createDataFrame([(i, page.format(x)) for i, x in enumerate(cut * 2)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert same_as_sql(spark, "html_valid_pages", str(tmp_path), "pages") == 14


def test_files_of_documents_lie_in_one_folder(spark, tmp_path, monkeypatch):
    """A table of one file is written by several tasks, without a folder for each document; ids, empty texts and line ends come back."""
    texts = ["a\nb", "", "\n", "7\n8", "ü\r\n", None, "x"] * 3
    spark.createDataFrame([(i if i % 20 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("glossaflow.plans.catalog.scratch.folder", lambda spark, what: f"{tmp_path}/held")
    assert same_as_sql(spark, "source_files", str(tmp_path), "documents") == 18
    made = [p for p in (tmp_path / "held").rglob("*") if not p.name.startswith((".", "_")) and (p.is_dir() or p.stat().st_size)]
    assert len(made) == 18 and all(p.is_file() and p.parent.name == "held" for p in made)
    assert len({p.name.split("-")[1] for p in made}) > 1


def test_files_of_documents_need_no_process_each(spark, tmp_path, monkeypatch):
    """On a disk the tasks make the files, not Hadoop, which leaves a file of checksums beside each and starts two processes for both; a second attempt makes the same ones; they are read by few tasks."""
    spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("ü"), F.col("id") % 5).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("glossaflow.plans.catalog.scratch.folder", lambda spark, what: f"{tmp_path}/held")
    assert same_as_sql(spark, "source_files", str(tmp_path), "documents") == 600
    assert len([*(tmp_path / "held").iterdir()]) == 600
    monkeypatch.setattr("glossaflow.plans.catalog.scratch.folder", lambda spark, what: f"{tmp_path}/again")
    assert QUERIES["source_files"](spark, str(tmp_path)).rdd.getNumPartitions() <= 16
    assert {p.name for p in (tmp_path / "again").iterdir()} == {p.name for p in (tmp_path / "held").iterdir()}


def test_files_of_equal_texts(spark, tmp_path):
    """Equal rows have a file each; an existing folder is refused."""
    rows = spark.createDataFrame([("a",)] * 3 + [("",), ("ü\n",)], "text string").coalesce(1)
    documents.write_files(rows, f"{tmp_path}/held")
    for plain in (True, False):
        assert sorted(r.text for r in documents.from_files(spark, f"{tmp_path}/held", plain=plain).collect()) == ["\n", "a\n", "a\n", "a\n", "ü\n\n"]
    with pytest.raises(FileExistsError):
        documents.write_files(rows, f"{tmp_path}/held")
