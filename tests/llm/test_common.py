"""Shared folder, scratch tables, hashes of spans."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from glossaflow.llm import common, windows
from glossaflow.llm.common import Scratch


class Named:
    """A session that has only settings."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return {}


def test_the_named_folder_is_used():
    assert common.shared_dir(Named("spark://x", "hdfs:///a/")) == "hdfs:///a" and common.shared_dir(Named("local[2]", "file:///b")) == "file:///b"
    assert common.shared_dir(Named("local[2]")).startswith("file:///") and common.shared_dir(Named("local")) == common.shared_dir(Named("local[2]"))
    for master in ("spark://x", "yarn", "local-cluster[1,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            common.shared_dir(Named(master))


def test_scratch_tables(spark):
    scratch = Scratch(spark, "what")
    df = scratch.table("t", spark.range(3))
    folder = scratch.top.removeprefix("file://") + "/t"
    assert df.count() == 3 and list(Path(folder).glob("*.parquet"))
    scratch.drop("t", "never made")
    assert not Path(folder).exists()


def test_span_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"abcXYZabc", np.uint8)
    sums = common.prefix_hash(common.byte_values(data))
    h = common.span_hash(sums, np.array([0, 6, 1, 3]), np.array([3, 9, 4, 6]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_word_spans():
    column = pa.array(["  a bb\n", None, "", "c", "d\x1fe f \t"])
    data, lo, hi = common.text_buffer(column)
    starts, ends, firsts = common.word_spans(data, lo, hi)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert words == ["a", "bb", "c", "d\x1fe f"] and firsts.tolist() == [0, 2, 2, 2, 3, 4]
    data, lo, hi = common.text_buffer(column.slice(3))
    assert [bytes(data[a:b]).decode() for a, b in zip(*(x.tolist() for x in common.word_spans(data, lo, hi)[:2]), strict=True)] == words[2:]


def test_filters_let_through_what_they_hold(spark):
    import pickle

    rnd = np.random.default_rng(5)
    hashes = rnd.integers(-(2**63), 2**63 - 1, 500)
    held = windows.filter_of(spark.createDataFrame([(int(h),) for h in hashes], "h long"), "h").value
    again = pickle.loads(pickle.dumps(held))
    assert len(pickle.dumps(held)) < 100_000
    for f in (held, again):
        assert windows.allowed(f, hashes).all() and windows.allowed(f, rnd.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    words = np.arange(1 << (windows.FILTER_BITS - 6))
    full = windows.Filter(words, np.full(len(words), 2**64 - 1, np.uint64))
    assert windows.allowed(pickle.loads(pickle.dumps(full)), hashes).all()
