"""SimHash document fingerprints, native.

The terms of a text are its windows of three words. A term weighs one for each
binary digit of its length in characters, so at most 32; each term's hash votes
with its weight on 128 signed bits, and the sign of a bit's sum is the
fingerprint's bit. Two counters of 32 bits share one long, so 64 sums in
generated code hold all votes. A document's terms are summed where they stand,
before anything is shuffled.

``within`` finds all pairs of a query and a fingerprint within a Hamming radius
by permuted block tables: with b blocks and radius r, at least b - r blocks are
equal, so each choice of b - r blocks is a table with an exact key.

Defined results: a null text is empty; a text without words has the zero
fingerprint; a text of fewer than three words is one term; equal texts have
equal fingerprints; a text whose terms weigh 2 ** 32 or more together, which
would need hundreds of millions of words, is refused with an error; ids may be
of any kind that can be ordered; a document whose id repeats is followed by its
repetition, in the order of the texts' hashes; a null id comes last; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, barrier, range_bounds

BITS = 128
_LANES, _PAIR = 32, 0x0000000100000001
#: The query's Hamming radius, and the blocks of its tables: a pair within the radius has an equal block.
RADIUS, BLOCKS = 3, 4


def fingerprints(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """key (unique) and fingerprint, 32 hex digits, of each row. Keys may be any columns."""
    df = barrier(texts.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("_t")), _w=F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "")).drop("_t")
    df = barrier(df, _h=F.transform("_w", lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).alias("n")))).drop("_w")
    # a short text is padded to one window; the parts it lacks are null
    df = df.withColumn("_h", F.when(F.size("_h") < 3, F.concat("_h", F.expr("array_repeat(cast(null as struct<h: bigint, n: int>), 3 - size(_h))"))).otherwise(F.col("_h")))
    df = barrier(df, _g=F.arrays_zip("_h", F.slice("_h", F.lit(2), F.size("_h")), F.slice("_h", F.lit(3), F.size("_h")))).drop("_h")
    df = df.select(*key, F.explode(F.slice("_g", F.lit(1), F.size("_g") - 2)).alias("_g"))
    a, b, c = (F.col(f"_g.{x}") for x in df.schema["_g"].dataType.names)
    length = F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0)) + F.coalesce(c["n"], F.lit(0))
    weight = F.floor(F.log2(F.greatest(length, F.lit(1)))) + F.when(length > 0, 1).otherwise(0)
    df = df.select(*key, F.xxhash64(a["h"], b["h"], c["h"]).alias("_x"), weight.alias("_v")).select(*key, "_x", "_v", F.xxhash64("_x", F.lit(7)).alias("_y"))
    sums = [F.sum(F.shiftrightunsigned(x, i).bitwiseAND(F.lit(_PAIR)) * F.col("_v")).alias(f"{x}{i}") for x in ("_x", "_y") for i in range(_LANES)]
    votes = df.groupBy(*key).agg(*sums, F.sum("_v").alias("_all"))
    votes = votes.withColumn("_all", F.when(F.col("_all") >= 1 << 32, F.raise_error(F.lit("a text has too many terms for its counters")).cast("long")).otherwise(F.col("_all")))

    def half(x: str, high: bool) -> Column:
        """32 bits: bit i is set where more than half of all weight voted for it."""
        bits = F.lit(0).cast("long")
        for i in range(_LANES):
            n = F.shiftrightunsigned(f"{x}{i}", 32) if high else F.col(f"{x}{i}").bitwiseAND(F.lit(0xFFFFFFFF))
            bits = bits + F.when(2 * n > F.col("_all"), F.lit(1 << i)).otherwise(0)
        return F.lpad(F.hex(bits), 8, "0")

    return votes.select(*key, F.lower(F.concat(*[half(x, high) for x in ("_x", "_y") for high in (True, False)])).alias("fingerprint"))


def words_of(fingerprint: Column) -> list[Column]:
    """The fingerprint as four longs of 32 bits each."""
    return [F.conv(F.substring(fingerprint, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(BITS // 32)]


def distance(a: Column, b: Column) -> Column:
    """The Hamming distance of two fingerprints."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words_of(a), words_of(b), strict=True)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return (1 - distance(a, b) / BITS).cast("double")


def within(queries: DataFrame, index: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Every (query, found, distance) of distinct fingerprints at most radius apart. Complete for every radius < blocks; copies are collapsed before."""
    blocks = blocks or radius + 2
    if not 0 <= radius < blocks <= 32:
        raise ValueError("blocks must be more than radius, and at most 32")
    width = BITS // 4
    edges = [width * i // blocks for i in range(blocks + 1)]
    cuts = F.array(*[F.concat(*[F.substring("fingerprint", a + 1, b - a) for k in chosen for a, b in [edges[k : k + 2]]], F.lit(f"/{t}")) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])

    def tables(df: DataFrame, name: str) -> DataFrame:
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.explode(cuts).alias("_key"))

    a, b = tables(queries, "query").alias("a"), tables(index, "found").alias("b")
    pairs = a.join(b, (F.col("a._key") == F.col("b._key")) & (distance(F.col("query"), F.col("found")) <= radius))
    return pairs.select("query", "found").distinct().withColumn("distance", distance(F.col("query"), F.col("found")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_in_bucket: int = 4_000, most_buckets: int = 65_536) -> DataFrame:
    """doc_id, _t, _next of each row: its text and that of the next row in descending order of ids of any kind, after the last that of the first. _key is unique and _next_key the next row's.

    Rows are dealt into buckets that are ranges of (id, hash of the text) with about as many rows each, from a sample of both, and texts are shuffled once, by bucket. The first row of each bucket also goes, as a copy, to the end of the bucket before it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    bounds = range_bounds(rows.select("doc_id", "_h"), ["doc_id", "_h"], rows_in_bucket, most_buckets)
    rows = rows.withColumn("_b", F.lit(bounds.n) - bounds.below([F.col("doc_id"), F.col("_h")])).withColumn("_guest", F.lit(False))
    # a copy of each bucket's first row is a guest at the end of the bucket before it: first its place from ids and hashes alone, then its text
    first = F.struct("doc_id", "_h")
    tops = rows.groupBy("_b").agg(F.max(first).alias("_top"))  # as many as buckets, each with an id and a hash
    present = sorted(r[0] for r in tops.select("_b").collect())
    before = dict(zip(present[1:] + present[:1], present, strict=True))
    after = {a: b for b, a in before.items()}
    listed = lambda held: F.from_json(F.lit(str([held.get(b, 0) for b in range(bounds.n + 1)])), "array<int>")
    tops = rows.join(F.broadcast(tops.select(F.col("_b").alias("_tb"), "_top")), (F.col("_b") == F.col("_tb")) & first.eqNullSafe(F.col("_top"))).groupBy("_b", "doc_id", "_h").agg(F.min("_t").alias("_t"))
    guests = tops.select("doc_id", "_t", "_h", F.element_at(listed(before), F.col("_b") + 1).alias("_b"), F.lit(True).alias("_guest"))
    in_bucket = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    dealt = rows.unionByName(guests).select("*", F.row_number().over(in_bucket).alias("_n"), F.lead("_t").over(in_bucket).alias("_next"), F.lead("_guest").over(in_bucket).alias("_last"))
    key = lambda b, n: F.shiftleft(b.cast("long"), 34) + n
    return dealt.where("not _guest").select("doc_id", "_t", "_next", key(F.col("_b"), F.col("_n")).alias("_key"), F.when(F.col("_last"), key(F.element_at(listed(after), F.col("_b") + 1), F.lit(1))).otherwise(key(F.col("_b"), F.col("_n") + 1)).alias("_next_key"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: n_chars, sha-256 of the edited text, the fingerprints of both texts, the likeness of the text's to the edited text's and to the next row's, and near_queries: how many fingerprints of the queries, which are the rows whose id is divisible by 50, are at most RADIUS bits away. Ids that are no whole numbers are never queries."""
    n = F.length("_t")
    df = barrier(with_next(docs, id_col, text_col), _edited=F.concat(F.expr("substring(_t, 1, length(_t) - floor(length(_t) / 2))"), F.expr("substring(_next, 1, floor(length(_t) / 2))")), n_chars=n.cast("long"))
    about = ["_key", "_next_key", "doc_id", "n_chars", "edited_sha256"]
    df = df.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    both = df.select(*about, F.inline(F.array(F.struct(F.lit(0).alias("_kind"), F.col("_t").alias("_text")), F.struct(F.lit(1).alias("_kind"), F.col("_edited").alias("_text")))))
    prints = fingerprints(both, [*about, "_kind"], "_text")
    # written, as each row is read twice: for itself and as the next one
    per = prints.groupBy(*about).agg(*[F.max(F.when(F.col("_kind") == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(("fingerprint", "edited_fingerprint"))])
    per = Scratch(docs.sparkSession, "simhash").table("fingerprints", per)
    following = per.select(F.col("_key").alias("_next_key"), F.col("fingerprint").alias("_following"))
    query = per.where(F.expr("try_cast(doc_id as bigint) % 50 = 0"))
    near = within(query, per, RADIUS, BLOCKS).groupBy("found").agg(F.count(F.lit(1)).alias("near_queries"))
    out = per.join(following, "_next_key").join(near, F.col("fingerprint") == F.col("found"), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"), F.coalesce("near_queries", F.lit(0)).alias("near_queries"))
