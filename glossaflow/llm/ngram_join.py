"""Jaccard self-join of word n-gram sets: size-aware, heavy and light.

Equal sets are one class, so copies never meet. Of the classes,

* light ones (few n-grams) enumerate the subsets that a linked pair can have in
  common, each of a fixed size: two of them that share such a subset are linked
  by their sizes alone;
* heavy ones scan inverted lists over their rarest n-grams: an order by
  the frequency of their words, from a sketch of bounded size over all
  documents, puts the rarest first, and a linked pair must share k of the first
  n - ceil(t * n) + k. So a set without k shared ones is out, and of the others
  the k - 1 that stand in most lists are.

The border between them is chosen by the cost of both from the histogram of
sizes. Candidates of a list are not all pairs: first each set is compared with
one of its lists' hubs, links join components, and only lists with members of
different components go on. Of those the short ones are compared in full and
are done; in long ones each member meets the nearest of some hubs, round by
round, while that joins many. What is left then is joined by cells of size, so
that no link between components is lost: two sets of a long list that share a
token of a short one have met there, and else all that a set has of short lists
or alone is missing from the other, which leaves a narrow interval of sizes, in
most sets none. Pairs are first held against parity bits of both sets, which
bound from below by how much the sets differ.

Defined results: a text without words (null, empty) has no n-grams and is
linked with nothing; a text of fewer words than n is one n-gram; repeated rows
are equal documents; null ids take part and never name a component unless all
ids in it are null; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_values, merged, mix64, prefix_hash, span_hash, text_buffer, tidy, word_spans
from .components import components
from .windows import Filter, allowed, filter_of, row_runs

#: Counters of the sketch: 2 ** 20 of 32 bits, 4 MB whatever the corpus.
SKETCH_BITS = 20
#: Linked sets share at least a token for so many n-grams within their prefixes, which are longer for it.
SHARE = 16
#: Longs of a set's parity bits.
PARITY = 8
#: Hubs of a list in a round after the first; lists of no more members are compared in full.
HUBS = 32
_BITS = [f"s{i}" for i in range(PARITY)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Join:
    """Links of sets with den * intersection >= num * union."""

    n: int = 3
    num: int = 90
    den: int = 100
    lower: bool = True

    def least_overlap(self, size: int) -> int:
        """Of a set of this size with any set that it is linked with."""
        return -(-self.num * size // self.den)

    def least_shared(self, size: int) -> int:
        """Of the prefixes of two linked sets, the smaller of this size."""
        return 1 + size // SHARE

    def prefix(self, size: int) -> int:
        """So many of a set's n-grams in a common order that two linked sets share at least least_shared() of the smaller within their prefixes."""
        return min(size, size - self.least_overlap(size) + self.least_shared(size))


def _spelled(column, how: Join):
    """(first row, row after the last, hashes of words, first word of each row and the end) of portions of an Arrow text column."""
    data, lo, hi = text_buffer(column)
    for a, b in row_runs(lo, hi, 300_000):
        base, end = int(lo[a]), int(hi[b - 1])
        part = data[base:end]
        starts, ends, firsts = word_spans(part, lo[a:b] - base, hi[a:b] - base)
        sums = prefix_hash(byte_values(_LOWER[part] if how.lower else part))
        yield a, b, span_hash(sums, starts, ends), firsts


def _grams(words: np.ndarray, firsts: np.ndarray, n: int):
    """(index of the row, first gram, gram after the last, hashes of all grams); a row of fewer words than n has its whole sequence."""
    sums = prefix_hash(words)
    last = np.arange(max(len(words) - n + 1, 0))
    grams = span_hash(sums, last, last + n)
    for i, (first, stop) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        if stop - first >= n:
            yield i, first, stop - n + 1, grams
        elif stop > first:
            yield i, 0, 1, span_hash(sums, np.array([first]), np.array([stop]))
        else:
            yield i, 0, 0, grams


def batch_sets(column, how: Join):
    """(row, sorted distinct n-gram hashes) of every row of an Arrow text column."""
    for a, _, words, firsts in _spelled(column, how):
        for i, first, stop, grams in _grams(words, firsts, how.n):
            got = np.sort(grams[first:stop])
            yield a + i, got[np.concatenate([[True], got[1:] != got[:-1]])] if len(got) else got


def ordered_sets(column, how: Join, counts: np.ndarray):
    """(row, sorted distinct n-gram hashes, their places in the common order) of every row with words. The order is that of the product of their words' frequencies, which is how often chance would repeat an n-gram."""
    for a, _, words, firsts in _spelled(column, how):
        # in whole numbers, so that an n-gram has the same place in every text
        rarity = np.rint(32 * np.log2(1.0 + counts[(words >> np.uint64(64 - SKETCH_BITS)).astype(np.intp)])).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(rarity)])
        last = max(len(words) - how.n + 1, 0)
        chance = np.clip(sums[how.n : how.n + last] - sums[:last], 0, (1 << 20) - 1).astype(np.uint64)
        for i, first, stop, grams in _grams(words, firsts, how.n):
            if stop == first:
                continue
            got, at = np.unique(grams[first:stop], return_index=True)
            key = got & np.uint64((1 << 40) - 1)
            if firsts[i + 1] - firsts[i] >= how.n:
                key = key | chance[first + at] << np.uint64(40)
            yield a + i, got, key


def set_id(grams: np.ndarray) -> int:
    """A 64-bit name of a set; with its size it identifies the class."""
    x = mix64(grams + np.uint64(0x632BE59BD9B4E019))
    return int(mix64(np.array([x.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix64(x))], np.uint64)).view(np.int64)[0])


def described(docs: DataFrame, how: Join) -> DataFrame:
    """A row for each document (doc_id, dh, n, sid) and, with a bucket, how many of the task's words fall on that counter of the sketch of word frequencies."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches):
        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "dh", "n", "sid", "bucket", "words"]
        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.column("doc_id").type
            n, sid = [], []
            for _, _, words, firsts in _spelled(batch.column("text"), how):
                sketch += np.bincount((words >> np.uint64(64 - SKETCH_BITS)).astype(np.intp), minlength=len(sketch))
                for _, first, stop, grams in _grams(words, firsts, how.n):
                    got = np.sort(grams[first:stop])
                    got = got[np.concatenate([[True], got[1:] != got[:-1]])] if len(got) else got
                    n.append(len(got))
                    sid.append(set_id(got) if len(got) else 0)
            rows = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dh"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], names)
        held = np.flatnonzero(sketch)
        rows = len(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(rows, doc_type), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.array(held.astype(np.int32)), pa.array(sketch[held])], names)

    return docs.select("doc_id", "dh", "text").mapInArrow(tidy(made), f"doc_id {kind}, dh long, n long, sid long, bucket int, words long")


def sketch_of(table: DataFrame) -> np.ndarray:
    """The tasks' counts added up by counter; the driver gets a row for each, at most 2 ** SKETCH_BITS."""
    sums = table.where("bucket is not null").groupBy("bucket").agg(F.sum("words").alias("words")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    out[sums.column("bucket").to_numpy()] = np.minimum(sums.column("words").to_numpy(), 2**32 - 1)
    return out


def border(sizes: dict[int, int], how: Join, scan_cost: float = 8.0, most: int = 40) -> int:
    """The greatest size of light sets: the least sum of subsets enumerated below it and of list entries scanned above."""

    def light(n: int) -> int:
        return sum(comb(n, d) for d in range(n - how.least_overlap(n) + 1))

    def cost(x: int) -> float:
        return sum(c * light(n) for n, c in sizes.items() if n <= x) + sum(c * scan_cost * how.prefix(n) for n, c in sizes.items() if x < n <= most or x < n and how.least_overlap(n) <= x)

    return min(range(most + 1), key=cost)


def _postings(column, how: Join, counts: np.ndarray, light: int):
    """(token, c, sid, n, place) arrays of portions of an Arrow text column, each set once: subsets of size c of light sets, and with c = 0 the first n-grams in the common order of all sets that a heavy one may meet."""
    seen: set[int] = set()
    for rows in _portions(ordered_sets(column, how, counts), 100_000):
        held: list[tuple] = []
        for _, grams, order in rows:
            size, name = len(grams), set_id(grams)
            if name in seen:
                continue
            seen.add(name)
            if size <= light:
                for k in range(how.least_overlap(size), size + 1):
                    subsets = np.array([set_id(grams[list(x)]) for x in combinations(range(size), k)], np.int64)
                    held.append((subsets, k, name, size, np.zeros(len(subsets), np.int32)))
            if size > light or size >= how.least_overlap(light + 1):
                p = how.prefix(size)
                few = np.argpartition(order, p - 1)[:p] if p < size else np.arange(size)
                few = few[np.argsort(order[few], kind="stable")]
                held.append((grams[few].view(np.int64), 0, name, size, np.arange(p, dtype=np.int32)))
        if held:
            lengths = [len(x[0]) for x in held]
            spread = lambda i, t: np.repeat(np.array([x[i] for x in held], t), lengths)
            yield np.concatenate([x[0] for x in held]), spread(1, np.int32), spread(2, np.int64), spread(3, np.int32), np.concatenate([x[4] for x in held])


def _firsts_only(batch, bitmap: Filter):
    """The texts of the documents that a filter of dh lets through."""
    import pyarrow as pa

    return batch.column("text").take(pa.array(np.flatnonzero(allowed(bitmap, batch.column("dh").to_numpy()))))


def tokens(docs: DataFrame, how: Join, sketch, light: int, firsts) -> DataFrame:
    """(token, n): how many sets of a batch have the token, by batch. Only documents that the filter firsts lets through are looked at."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for token, *_ in _postings(_firsts_only(batch, firsts.value), how, sketch.value, light):
                t, n = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n.astype(np.int32))], ["token", "n"])

    return docs.select("dh", "text").mapInArrow(tidy(made), "token long, n int").groupBy("token").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, how: Join, sketch, light: int, firsts, shared) -> DataFrame:
    """(token, c, sid, n, place) of tokens that the filter shared lets through, for sets with enough of them."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for token, *rest in _postings(_firsts_only(batch, firsts.value), how, sketch.value, light):
                ok = allowed(shared.value, token)
                # of a set that shares fewer tokens than any link has, nothing is dealt
                c, name, size, _ = rest
                starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (c[1:] != c[:-1])]))
                enough = np.add.reduceat(ok, starts, dtype=np.int64) >= [1 if k else how.least_shared(how.least_overlap(n)) for k, n in zip(c[starts].tolist(), size[starts].tolist(), strict=True)]
                ok &= np.repeat(enough, np.diff(np.append(starts, len(token))))
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (token, *rest)], ["token", "c", "sid", "n", "place"])

    return docs.select("dh", "text").mapInArrow(tidy(made), "token long, c int, sid long, n int, place int")


def _portions(items, most: int):
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x[1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _may_link(a: str, b: str, how: Join) -> Column:
    """By sizes and by the places of a common n-gram in both orders: before it they share at most the fewer, after it likewise."""
    na, nb, pa, pb = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}place", f"{b}place"))
    most = F.least(pa, pb) + 1 + F.least(na - pa, nb - pb) - 1
    return (how.den * F.least(na, nb) >= how.num * F.greatest(na, nb)) & (how.den * most >= how.num * (na + nb - most))


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """Bit i of PARITY longs: whether an odd number of n-grams falls on it. Bits in which two sets differ are at most as many as n-grams that only one of them has."""
    odd = np.bincount((grams & np.uint64(64 * PARITY - 1)).astype(np.intp), minlength=64 * PARITY).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sets_of(docs: DataFrame, bitmap, how: Join) -> DataFrame:
    """(sid, parity bits, grams) of the classes of which the filter lets a document through. Texts are read through a filter and not shuffled."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _portions(batch_sets(_firsts_only(batch, bitmap.value), how), 100_000):
                part = [g for _, g in part if len(g)]
                bits = np.array([parity_bits(g) for g in part], np.int64).reshape(-1, PARITY)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(g) for g in part], pa.int64()), *(pa.array(bits[:, i].copy()) for i in range(PARITY)), pa.array([g.tobytes() for g in part], pa.binary())], ["sid", *_BITS, "grams"])

    return docs.select("dh", "text").mapInArrow(tidy(made), "sid long, " + ", ".join(f"{c} long" for c in _BITS) + ", grams binary")


def _differ() -> Column:
    """In how many parity bits two sets a, b differ."""
    return sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _BITS), F.lit(0))


def _bits_allow(how: Join) -> Column:
    """Whether two sets a, b may be linked by their parity bits."""
    return _differ() * (how.den + how.num) <= (F.col("an") + F.col("bn")) * (how.den - how.num)


def _least_shared(size: Column) -> Column:
    """Join.least_shared() of a column."""
    return 1 + F.floor(size / SHARE)


def pruned(heavy: DataFrame, how: Join) -> DataFrame:
    """Postings (a written table) without those that link nothing: tokens of one set, sets that share fewer tokens with all others than any link has, and of each set its most common tokens, as many as that minimum less one: a linked pair still has a token left. shared: how many of a set's tokens others have. common: how many n-grams the set has but for those of its prefix that stand in no list or in one of at most HUBS sets.

    Of two sets one has the prefix that ends earlier in the common order, and what of it the other has is in both prefixes. So two sets
    without a common short list share at most the greater of their two numbers common."""
    in_lists = heavy.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    of_set = Window.partitionBy("sid")  # at most a set's prefix
    ranked = heavy.join(merged(in_lists), "token").select("*", F.row_number().over(of_set.orderBy("m", "token")).alias("rank"), F.count(F.lit(1)).over(of_set).cast("int").alias("shared"), F.sum(F.when(F.col("m") > HUBS, 1).otherwise(0)).over(of_set).cast("int").alias("long"))
    n = F.col("n")
    prefix = F.least(n, n - F.ceil(n * how.num / how.den) + _least_shared(n))
    ranked = ranked.withColumn("common", (n - prefix + F.col("long")).cast("int"))
    least = _least_shared(F.ceil(F.col("n") * how.num / how.den))
    return ranked.where(F.col("rank") <= F.col("shared") - least + 1).drop("m", "rank", "long")


def verified(pairs: DataFrame, sets: DataFrame, how: Join, hub_rows: int = 2_000) -> DataFrame:
    """The pairs (u, v) that are linked. Members are dealt to copies of their hub's set, a copy for every hub_rows of them, so that no hub gathers all."""
    shares = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / hub_rows).cast("int").alias("shares"))
    members = pairs.join(merged(shares), "u").withColumn("share", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int"))
    members = members.join(merged(sets.withColumnRenamed("sid", "v")), "v").select("u", "share", "v", "grams")
    hubs = shares.join(merged(sets.withColumnRenamed("sid", "u")), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("v"), "grams")
    dealt = hubs.unionByName(members).repartition("u", "share").sortWithinPartitions("u", "share", F.col("v").asc_nulls_first())

    def compared(batches):
        import pyarrow as pa

        hub, name = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, raw in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("grams"), strict=True):
                grams = np.frombuffer(raw.as_buffer(), np.uint64)
                if v is None:
                    hub, name = grams, u
                    continue
                if name != u:
                    continue
                at = np.searchsorted(hub, grams)
                common = int((hub[np.minimum(at, len(hub) - 1)] == grams).sum())
                if how.den * common >= how.num * (len(hub) + len(grams) - common):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(tidy(compared), "u long, v long")


def _sides(left: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of lists as the members a and b of pairs."""
    named = lambda df, side: df.select("token", *[F.col(c).alias(f"{side}{c}") for c in df.columns if c not in ("token", "members", "hub")])
    return named(hubs, "a"), named(left, "b")


def _all_pairs(left: DataFrame, how: Join) -> DataFrame:
    """(u, v): what may be linked of any two members of a list that are in different components."""
    a, b = _sides(left, left)
    met = a.join(merged(b), (a["token"] == b["token"]) & (F.col("asid") < F.col("bsid")) & (F.col("acomp") != F.col("bcomp")) & _may_link("a", "b", how) & _bits_allow(how))
    return met.select(F.col("asid").alias("u"), F.col("bsid").alias("v")).distinct()


def _cell(n: Column) -> Column:
    """A number that grows with n: up to 256 n itself, then 64 to each doubling."""
    return F.when(n < 256, n).otherwise(256 + F.floor(F.log2(n / 256) * 64)).cast("int")


def _with_shorter(left: DataFrame) -> DataFrame:
    """Rows of lists with before: the set's lists that are shorter than this one."""
    shorter = Window.partitionBy("sid").orderBy("members", "token").rowsBetween(Window.unboundedPreceding, -1)  # at most a set's prefix
    return left.withColumn("before", F.collect_list("token").over(shorter))


def _cells(left: DataFrame, how: Join) -> tuple[DataFrame, DataFrame]:
    """Rows of long lists as members a and b of pairs: b by the cell of its size, a by all cells of sizes, lo to hi, with which it can be linked by sharing at most its number common."""
    n = F.col("n")
    most = F.floor(F.col("common") * (how.den + how.num) / how.num) - n
    lo, hi = F.ceil(n * how.num / how.den), F.least(F.floor(n * how.den / how.num), most)
    narrowed = _with_shorter(left).withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")})
    a, b = _sides(narrowed.withColumn("cell", _cell(n)), narrowed.where("lo <= hi").withColumn("cell", F.explode(F.sequence(_cell(F.col("lo")), _cell(F.col("hi"))))))
    return a, b


def _cell_pairs(left: DataFrame, how: Join) -> DataFrame:
    """(u, v): what may be linked of any two members of a long list that are in different components and have no short list in common. Two sets meet once: in the shortest of their common lists, and from one side if both reach each other."""
    a, b = _cells(left, how)
    reached = F.col("bn").between(F.col("alo"), F.col("ahi")) & ((F.col("asid") < F.col("bsid")) | (F.col("asid") > F.col("bsid")) & ~F.col("an").between(F.col("blo"), F.col("bhi")))
    met = a.join(merged(b), (a["token"] == b["token"]) & (F.col("acell") == F.col("bcell")) & reached & (F.col("acomp") != F.col("bcomp")) & _may_link("a", "b", how) & _bits_allow(how) & ~F.arrays_overlap("abefore", "bbefore"))
    return met.select(F.least("asid", "bsid").alias("u"), F.greatest("asid", "bsid").alias("v")).distinct()


def _hub_pairs(left: DataFrame, how: Join, r: int) -> DataFrame:
    """(u, v): each member v with that one of its lists' HUBS hubs in other components that its parity bits are nearest to. Two sets meet once, in the shortest of their common lists, so that copies which share many lists don't meet in each; a member meets all hubs of its shortest list."""
    left = _with_shorter(left)
    hubs = left.withColumn("hub", F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("sid", F.lit(r)), "sid"))).where(F.col("hub") <= HUBS)
    a, b = _sides(left, hubs)
    met = b.join(merged(a), "token").where((F.col("asid") != F.col("bsid")) & (F.col("acomp") != F.col("bcomp")) & _may_link("a", "b", how) & _bits_allow(how) & ~F.arrays_overlap("abefore", "bbefore"))
    best = met.groupBy("bsid").agg(F.min(F.struct(_differ().alias("d"), "asid")).alias("x"))
    return best.select(F.col("x.asid").alias("u"), F.col("bsid").alias("v"))


def _first_pairs(heavy: DataFrame, bits: DataFrame, how: Join) -> DataFrame:
    """(u, v): each set v with that one of its lists' hubs that it shares most lists with. The hub of a list is the set that shares most of its tokens."""
    hubs = heavy.groupBy("token").agg(F.min(F.struct((-F.col("shared") / F.col("n")).alias("o"), F.xxhash64("sid").alias("h"), F.col("sid").alias("asid"), F.col("n").alias("an"), F.col("place").alias("aplace"))).alias("hub"))
    met = heavy.select("token", F.col("sid").alias("bsid"), F.col("n").alias("bn"), F.col("place").alias("bplace")).join(merged(hubs), "token").select("*", "hub.*")
    met = met.where((F.col("asid") != F.col("bsid")) & _may_link("a", "b", how)).groupBy("bsid", "bn", "asid", "an").agg(F.count(F.lit(1)).alias("lists"))
    best = met.groupBy("bsid", "bn").agg(F.max(F.struct("lists", "asid", "an")).alias("x")).select("bsid", "bn", F.col("x.asid").alias("asid"), F.col("x.an").alias("an"))
    for side in "ab":
        best = best.join(merged(bits.select(F.col("sid").alias(f"{side}sid"), *[F.col(c).alias(f"{side}{c}") for c in _BITS])), f"{side}sid")
    return best.where(_bits_allow(how)).select(F.col("asid").alias("u"), F.col("bsid").alias("v"))


def linked(docs: DataFrame, how: Join, scratch: Scratch, most_rounds: int = 6, pair_budget: int = 16) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, dh, n, sid; links: u, v between classes, enough to connect all that are linked). docs: doc_id, dh, text."""
    spark = docs.sparkSession
    table = scratch.table("described", described(docs, how))
    of_docs = table.where("bucket is null").select("doc_id", "dh", "n", "sid")
    per_class = of_docs.where("n > 0").groupBy("sid", "n").agg(F.min("dh").alias("dh"))
    sizes = {r[0]: r[1] for r in per_class.where("n <= 64").groupBy("n").count().collect()}  # at most 64 rows
    light = border(sizes, how)
    sketch = spark.sparkContext.broadcast(sketch_of(table))
    # one document of each class stands for it; tokens of one class link nothing and are left out before anything is dealt
    stand = filter_of(per_class, "dh")
    several = filter_of(tokens(docs, how, sketch, light, stand).where("n > 1"), "token")
    scratch.drop()
    every = postings(docs, how, sketch, light, stand, several)
    lists = scratch.table("lists", every.groupBy("token", "sid").agg(F.min("c").alias("c"), F.min("n").alias("n"), F.min("place").alias("place")))
    for held in (sketch, stand, several):
        held.destroy()
    # light: the smallest set of a list is linked with every other that any member could be linked with
    small = lists.where("c > 0")
    hub = small.groupBy("token").agg(F.min(F.struct("n", "sid")).alias("hub"))
    links = [small.join(merged(hub), "token").where((F.col("sid") != F.col("hub.sid")) & (how.den * F.col("c") >= how.num * (F.col("n") + F.col("hub.n") - F.col("c")))).select(F.col("hub.sid").alias("u"), F.col("sid").alias("v")).distinct()]
    links = [scratch.table("links-light", links[0])]
    # heavy
    heavy = scratch.table("heavy", pruned(lists.where("c = 0").select("token", "sid", "n", "place"), how))
    scratch.drop("lists")
    firsts = per_class.join(merged(heavy.select("sid").distinct()), "sid").select("sid", "n", "dh")
    wanted = filter_of(firsts, "dh")
    sets = scratch.table("sets", sets_of(docs, wanted, how))
    wanted.destroy()
    # an own table, as it is read often and the sets are large
    bits = scratch.table("bits", sets.select("sid", *_BITS).dropDuplicates(["sid"]))

    def link(r: int, pairs: DataFrame) -> DataFrame:
        links.append(scratch.table(f"links{r}", verified(scratch.table(f"pairs{r}", pairs), sets.select("sid", "grams"), how)))
        scratch.drop(f"pairs{r}")
        return links[-1]

    # labels need not be whole components here: a set goes to the least of itself, its hub, and the hub's hub
    hub_of = link(0, _first_pairs(heavy, bits, how)).select(F.col("v").alias("sid"), F.col("u").alias("to")).distinct()
    label = hub_of.join(merged(hub_of.select(F.col("sid").alias("to"), F.col("to").alias("on"))), "to", "left").select("sid", F.least("sid", "to", "on").alias("component"))
    state = heavy.join(merged(label), "sid", "left").select("token", "sid", "n", "place", "common", F.coalesce("component", "sid").alias("comp"))
    written, before = ["heavy"], None
    for r in range(1, most_rounds + 2):
        # only lists with several components go on; a closed list never opens again
        ends = F.min("comp").alias("lo"), F.max("comp").alias("hi")
        still_open = state.groupBy("token").agg(F.count(F.lit(1)).alias("members"), *ends).where("lo <> hi").select("token", "members")
        left = state.join(merged(still_open), "token")
        left = scratch.table(f"left{r}", left.join(merged(bits), "sid") if r == 1 else left)
        scratch.drop(*written)
        written = [f"left{r}"]
        few, many = left.where(F.col("members") <= HUBS), left.where(F.col("members") > HUBS)
        per = many.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("all"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("cost"))
        cost, rows = per.agg(F.sum("cost"), F.sum("all")).first()
        # short lists are compared in full, and long ones by cells where that is little or hubs no longer join much
        full = not cost or cost <= pair_budget * rows or r > most_rounds or before is not None and cost > 0.7 * before
        before = cost
        found = link(r, _all_pairs(few, how).unionByName(_cell_pairs(many, how) if full else _hub_pairs(many, how, r)).distinct())
        if full:
            break
        label = left.select("sid", "comp").distinct()
        between = found.join(merged(label.select(F.col("sid").alias("u"), F.col("comp").alias("cu"))), "u").join(merged(label.select(F.col("sid").alias("v"), F.col("comp").alias("cv"))), "v")
        joined = components(between.select(F.col("cu").alias("u"), F.col("cv").alias("v")), scratch, f"joined{r}")
        written.append(f"joined{r}")
        state = many.drop("members").join(merged(joined.withColumnRenamed("node", "comp")), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
    scratch.drop("sets", "bits", *written)
    return of_docs, reduce(DataFrame.unionByName, links)


def _found(docs: DataFrame, how: Join, id_col: str, text_col: str, **limits) -> DataFrame:
    """doc_id, n, dh of every row, the component of its class (null without words) and the least id in it."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("dh"), text.alias("text"))
    of_docs, links = linked(named, how, scratch, **limits)
    nodes = components(links, scratch, "last")
    scratch.drop("links-light")
    classes = of_docs.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    classes = classes.join(merged(nodes.select(F.col("node").alias("sid"), "component")), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    groups = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = classes.join(merged(groups), "component").select("sid", "component", "component_id")
    return of_docs.join(merged(of_class), "sid", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")))


def with_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and dh, a hash of id and text that names the row."""
    out = _found(docs, how, id_col, text_col, **limits)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "dh")


def _comparable(docs: DataFrame) -> list[Column]:
    """The columns in an order that Spark can compare: maps and the like as strings."""
    return [F.col(f"`{f.name}`").cast("string") if re.search(r"map<|variant|interval", f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in docs.schema]


def one_of_each(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row of docs, whole, for each component: of its least id (null only if all are), and of that id's texts the one with the least hash. Of rows without words those that agree in id and text (null: empty) are one. Of rows that agree in id and text the first in order of all columns stays."""
    found = _found(docs, how, id_col, text_col, **limits)
    single = F.when(F.col("n") == 0, F.col("dh"))
    keep = found.groupBy("component", single.alias("single")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "dh")).alias("x")).select(F.col("x.dh").alias("_dh")).distinct()
    # repeated rows become one where they are read, so that however many they are none of them gather
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("_dh"), row.alias("_row"), F.struct(*_comparable(docs)).alias("_order"))
    plain = rows.schema["_row"].dataType == rows.schema["_order"].dataType
    rows = rows.groupBy("_dh").agg((F.min("_row") if plain else F.min_by("_row", "_order")).alias("_row"))
    return rows.join(merged(keep), "_dh", "left_semi").select("_row.*")
