"""Exact dedup of long byte strings by sorted suffixes.

Only the suffixes at anchors are sorted (see ``windows``): a string of ``size``
bytes that stands twice has the same anchor at the same place in it both times,
so the sampled suffixes find every repeat. Suffixes with an equal gram are
sorted deep-shallow: multikey quicksort to a shallow depth, then a blind trie
for each group that still shares its prefix. The text before the anchor is
sorted the same way, backwards. In either order, strings that share a prefix of
some length are a run between two low values of the common-prefix array, so a
window that reaches l bytes back stands twice if two suffixes are in one run of
both orders.

Entries are one class, of which one member is sorted, if a hash of 64 bits of
their whole stretch is equal within a gram (a hash of 64 bits itself). Groups of
more classes than ``most`` are not gathered in one task: their windows are
counted by hash in a shuffle instead, with the same result.

Defined results: null and empty texts, and texts shorter than a window, lose
nothing; repeated rows are documents of their own, so each repeats the other;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import Scratch, byte_values, merged, prefix_hash, span_hash, tidy
from .windows import DOC, Shape

DEFAULT = Shape(400, 128, "byte")
#: Bytes that multikey quicksort looks at; what is still equal goes to blind tries.
SHALLOW = 24


def _partition(strings: list[bytes], ids: list[int], depth: int, shallow: int, out: list[list[int]]) -> None:
    """Multikey quicksort of ids by strings from depth; groups that are equal up to shallow are left as they are. Without recursion, as groups may be many."""
    stack = [(ids, depth)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) == 1 or depth >= shallow:
            out.append(ids)
            continue
        # the character at depth; strings that have ended come first
        at = [strings[i][depth : depth + 1] for i in ids]
        pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
        less, same, more = [], [], []
        for i, c in zip(ids, at, strict=True):
            (same if c == pivot else less if c < pivot else more).append(i)
        if more:
            stack.append((more, depth))
        stack.append((same, depth + 1 if pivot else shallow))
        if less:
            stack.append((less, depth))


def common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of two strings that agree before at: doubling steps, then halving."""
    n = min(len(a), len(b))
    step = 16
    while at < n and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= n:
        return n
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, n)


class BlindTrie:
    """A compact trie that holds only branching depths and characters. A leaf is a list of equal strings' ids."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        # blind descent to some leaf, then the real common prefix with it
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            c = s[depth : depth + 1]
            node = children[c] if c in children else next(iter(children.values()))
        other = self.strings[node[0]]
        shared = common(s, other, 0)
        if shared == len(s) == len(other):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            parent, node = node, node[1][s[node[0] : node[0] + 1]]
        c = s[shared : shared + 1]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][c] = [i]
            return
        branch = (shared, {other[shared : shared + 1]: node, c: [i]})
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0] : parent[0] + 1]] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes], groups: list[list[int]], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Each group sorted by its strings: the ids, and for each the length of its common prefix with the one before (-1 where a group begins)."""
    order: list[int] = []
    firsts: list[int] = []
    for ids in groups:
        firsts.append(len(order))
        parts: list[list[int]] = []
        _partition(strings, ids, 0, shallow, parts)
        for part in parts:
            if len(part) > 1:
                trie = BlindTrie(strings)
                for i in part:
                    trie.add(i)
                part = trie.ordered()
            order += part
    lcp = np.array([0] + [common(strings[a], strings[b], 0) for a, b in zip(order, order[1:], strict=False)], np.int64)
    lcp[firsts] = -1
    return np.array(order, np.int64), lcp


def repeated_windows(before: list[bytes], after: list[bytes], groups: list[list[int]], lo: np.ndarray, hi: np.ndarray, several: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each string pair (the bytes before an anchor, backwards, and those from it on) the runs [l, m] of lo..hi such that the window that begins l to m bytes before the anchor stands in another pair of its group, or in a class of several."""
    n = len(before)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    right, right_lcp = deep_shallow(after, groups)
    left, left_lcp = deep_shallow(before, groups)
    right_run, left_run = np.empty(n, np.int64), np.empty(n, np.int64)
    opened = np.full(n, -1, np.int64)
    for l in range(int(lo.min()), int(hi.max()) + 2):  # noqa: E741
        right_run[right] = np.cumsum(right_lcp < size - l)
        left_run[left] = np.cumsum(left_lcp < l)
        ids = np.flatnonzero((lo <= l) & (l <= hi))
        again = np.zeros(n, bool)
        if len(ids):
            _, which, counts = np.unique(right_run[ids] * (n + 1) + left_run[ids], return_inverse=True, return_counts=True)
            again[ids] = (counts[which] > 1) | several[ids]
        for i in np.flatnonzero(again & (opened < 0)):
            opened[i] = l
        for i in np.flatnonzero(~again & (opened >= 0)):
            out[i].append((int(opened[i]), l - 1))
            opened[i] = -1
    return out


def _sorted_groups(found: DataFrame, shape: Shape) -> DataFrame:
    """found: gram, DOC, at, n, payload (the stretch of the entry). Spans of repeated windows of its rows with n = 1. All rows of a gram are in one task."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def made(batches):
        import pyarrow as pa

        def portion(table):
            grams = table.column("gram").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            groups = [list(range(a, b)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(grams)], strict=True)]
            place, lo, hi = windows.unpacked(table.column("at").to_numpy())
            texts = table.column("payload").to_pylist()
            n = table.column("n").to_numpy()
            runs = repeated_windows([t[:h][::-1] for t, h in zip(texts, hi.tolist(), strict=True)], [t[h:] for t, h in zip(texts, hi.tolist(), strict=True)], groups, lo, hi, n > 1, shape.size)
            rows = [(i, l, m) for i, held in enumerate(runs) if n[i] == 1 for l, m in held]
            at, l, m = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64) for _ in range(3))  # noqa: E741
            place = place[at]
            return pa.RecordBatch.from_arrays([*(table.column(c).take(pa.array(at)).combine_chunks() for c in DOC), pa.array(place - m), pa.array(place - l + shape.size)], [*DOC, "a", "b"])

        for table in windows.whole_groups(batches, 4000):
            yield portion(table)

    dealt = found.select("gram", *DOC, "at", "n", "payload").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(tidy(made), f"doc_id {kind}, th long, a long, b long")


def _counted_windows(found: DataFrame, shape: Shape) -> DataFrame:
    """The same for groups of any size, by hashes of all their windows in a shuffle."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            place, los, his = windows.unpacked(batch.column("at").to_numpy())
            for i, (text, lo, hi) in enumerate(zip(batch.column("payload").to_pylist(), los.tolist(), his.tolist(), strict=True)):
                sums = prefix_hash(byte_values(np.frombuffer(text, np.uint8)))
                starts = np.arange(hi - lo + 1)
                n = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(n) for c in ["gram", *DOC]), pa.array(np.full(len(starts), place[i])), batch.column("n").take(n), pa.array((hi - starts).astype(np.int32)), pa.array(span_hash(sums, starts, starts + shape.size).view(np.int64))], ["gram", *DOC, "place", "n", "l", "w"])

    each = found.select("gram", *DOC, "at", "n", "payload").mapInArrow(tidy(hashed), f"gram long, doc_id {kind}, th long, place long, n long, l int, w long")
    key = ["gram", "l", "w"]
    again = each.groupBy(*key).agg(F.sum("n").alias("all")).where("all > 1").select(*key)
    return each.where("n = 1").join(merged(again), key, "left_semi").select(*DOC, (F.col("place") - F.col("l")).alias("a"), (F.col("place") - F.col("l") + shape.size).alias("b"))


def repeated_spans(docs: DataFrame, shape: Shape, scratch: Scratch, most: int = 5_000) -> tuple[DataFrame, Broadcast | None]:
    """(doc_id, th, a, b): bytes a to b of strings that also start elsewhere. docs: doc_id, th, text. And the filter that they still need, if any."""
    several = windows.grams(docs, shape).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    found = windows.entries_of_grams(docs, shape, several, scratch)
    kinds = scratch.table("classes", windows.classes(found))
    scratch.drop()
    # classes with several members repeat whole
    whole = windows.whole_spans(windows.members_of(found, kinds.where("n > 1"), most), shape)
    wanted = kinds.where("not alone").select("gram", *[F.col(f"first.{c}").alias(c) for c in [*DOC, "at"]], "n", "kinds")

    def stretch(e, ok, sums, values):
        import pyarrow as pa

        return pa.array([values_to_bytes(values[a:b]).tobytes() for a, b in zip((e.here - e.hi)[ok].tolist(), (e.here - e.lo + shape.size)[ok].tolist(), strict=True)], pa.binary())

    looked, bitmap = windows.looked_up(docs, wanted, shape, "binary", stretch)
    if kinds.where(F.col("kinds") > most).isEmpty():
        return whole.unionByName(_sorted_groups(looked, shape)), bitmap
    # written, as groups of both sizes need it and the texts are to be read once
    looked = scratch.table("looked", looked)
    small, large = looked.where(F.col("kinds") <= most), looked.where(F.col("kinds") > most)
    return whole.unionByName(_sorted_groups(small, shape)).unionByName(_counted_windows(large, shape)), bitmap


_BYTE_OF = {int(v): i for i, v in enumerate(byte_values(np.arange(256, dtype=np.uint8)))}
_SORTED_VALUES = np.array(sorted(_BYTE_OF), np.uint64)
_SORTED_BYTES = np.array([_BYTE_OF[int(v)] for v in _SORTED_VALUES], np.uint8)


def values_to_bytes(values: np.ndarray) -> np.ndarray:
    """The bytes of which byte_values() made these."""
    return _SORTED_BYTES[np.searchsorted(_SORTED_VALUES, values)]


def remove_bytes(docs: DataFrame, spans: tuple[DataFrame, Broadcast | None], scratch: Scratch, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text: the kept bytes without parts of characters)."""

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, held in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode()
                runs = windows.covered((x["a"], x["b"]) for x in held or ())
                edges = [0, *(x for run in runs for x in run), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + with_text]
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][: 5 + with_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return windows.joined_spans(docs, spans, scratch).select("doc_id", "text", "spans").mapInArrow(tidy(kept), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)


def whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def cut_rows(docs: DataFrame, shape: Shape = DEFAULT, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", most: int = 5_000) -> DataFrame:
    """The rows of docs with text_col cut, whole characters only, and n_chars_col, if there is one, counted anew. Rows that lose all their text go; rows that had none stay."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    named = windows.named(docs, id_col, text_col)
    packed = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.col(f"row.{id_col}").alias("doc_id"), F.xxhash64(F.coalesce(f"row.{text_col}", F.lit(""))).alias("th"), F.col(f"row.{text_col}").alias("text"))
    joined = windows.joined_spans(packed, repeated_spans(named, shape, scratch, most), scratch).select("row", "text", "spans")

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, held in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                text = text.as_py()
                if text is not None and held:
                    raw = text.encode()
                    runs = [whole_characters(raw, a, b) for a, b in windows.covered((x["a"], x["b"]) for x in held)]
                    edges = [0, *(x for run in runs for x in run), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field("row"), pa.field("kept", pa.string())]))

    row_type = docs.schema.simpleString()
    cut = joined.mapInArrow(tidy(kept), f"row {row_type}, kept string").where("kept is null or trim(kept) <> '' or trim(row.`" + text_col + "`) = ''")
    again = {text_col: F.col("kept")} | ({n_chars_col: F.length("kept").cast(docs.schema[n_chars_col].dataType)} if n_chars_col in docs.columns else {})
    return cut.select(*[again[c].alias(c) if c in again else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def dedup(docs: DataFrame, shape: Shape = DEFAULT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most: int = 5_000) -> DataFrame:
    """The documents without bytes of strings of shape.size bytes that also start elsewhere."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = windows.named(docs, id_col, text_col)
    return remove_bytes(docs, repeated_spans(docs, shape, scratch, most), scratch, with_text)
