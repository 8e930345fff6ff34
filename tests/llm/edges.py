"""Small tables with the cases that every operator must define: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item long, _t string, _row string"


def words(n, seed, size=400):
    rnd = random.Random(seed)
    return [f"{rnd.choice('abcdefgh')}{rnd.choice(['lo', 'né', 'ß', 'ра', '中'])}{rnd.randrange(size)}" for _ in range(n)]


def rows():
    long = " ".join(words(30_000, 5, 3000))
    base = " ".join(words(120, 1))
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", "a b a b a b a", base, base, " ".join(near), long, "x" * 5000, "line here\n" * 60, base.upper(), "@@ <|endoftext|> end'll    it's", "a\u0000b c", " ".join(words(70, 2)) + "\n" + base, "# * $ % & | < >" * 40]
    out = [(i * 3, t, [None, "en", "fr"][i % 3], [None, "s1"][i % 2], None if t is None else len(t), None, "x", "y") for i, t in enumerate(texts)]
    return [*out, out[6], out[0], (None, base + " tail", "en", "s1", 1, 2, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(spark):
    """(name, frame) of the fixture and of the smallest table."""
    return [("edges", frame(spark)), ("documents", documents(spark))]
