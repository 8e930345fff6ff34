"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document and leaves one failure bit
beside its measurement. Policies are masks over those bits, so a new version of
a policy, or what a rule alone costs, is a bitwise aggregation over the ledger
and never a second look at the texts. Native DataFrame functions only; a
document is judged inside its own row, so nothing is shuffled and no key can
be hot.

Defined results: a null text has no words and fails ``too_short``; an empty
text likewise; repeated rows each get their own ledger row; further columns of
the input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, barrier

_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """fails: a condition over the measurements of measure()."""

    name: str
    fails: str


#: In the order of their bits; a rule is only ever added at the end, so that old ledgers keep their meaning.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("too_few_letters", "100 * n_letters < 50 * word_chars"),
    Rule("shouting", "100 * n_exclaims > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: a document goes if it fails any of these rules."""

    name: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        at = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << at[name] for name in set(self.rules))


BASE_POLICY = Policy("base", ("too_short", "repeated_windows"))
POLICIES = (
    BASE_POLICY,
    Policy("v1", ("too_short", "repeated_windows", "repeated_lines", "symbols")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col as doc_id, and what the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = barrier(docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")), _w=F.filter(F.split("_t", _SPLIT), lambda w: w != ""), _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    bare = F.translate("_t", WORD_BREAKS, "")
    df = barrier(
        df,
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(bare).cast("long"),
        n_symbols=(F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long"),
        n_exclaims=(F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long"),
        n_letters=F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long"),
        n_lines=F.size("_l").cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        # the hash of each window of three words, as an array
        _h=F.when(F.size("_w") >= 3, F.expr("transform(slice(_w, 1, size(_w) - 2), (w, i) -> xxhash64(w, _w[i + 1], _w[i + 2]))")).otherwise(F.expr("cast(array() as array<bigint>)")),
    ).drop("_t", "_w", "_l")
    # most texts repeat no window: only the others are sorted
    df = barrier(df, _s=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("array_sort(transform(_h, (h, i) -> struct(h, i)))")).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))).drop("_h")
    # get() is null beyond the ends
    df = barrier(df, _d=F.expr("array_sort(filter(transform(_s, (x, j) -> if(coalesce(get(_s, j - 1).h = x.h, false) or coalesce(get(_s, j + 1).h = x.h, false), x.i, null)), p -> p is not null))")).drop("_s")
    return df.withColumn("n_repeat_words", F.expr("aggregate(transform(_d, (p, j) -> least(3, coalesce(get(_d, j + 1) - p, 3))), 0L, (a, x) -> a + x)")).drop("_d")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure(), with failures: a long whose bit i is set where rules[i] fails."""
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return barrier(measure(docs, id_col, text_col), failures=bits)


def fails(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Over a ledger: whether the policy rejects the row."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def ablation(held: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: how many rows fail it, and how many only it rejects. One aggregation over distinct masks."""
    masks = held.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules])
    return (
        masks.select("m", "n", F.inline(rows))
        .groupBy("rule")
        .agg(F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"))
    )


def judged(docs: DataFrame, policy: Policy = POLICIES[-1], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and kept, the policy's name, and only_failure: the rule without which the row would be kept, if there is just one."""
    names = [r.name for r in RULES]
    mask = policy.mask() | BASE_POLICY.mask()
    bad = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    alone = F.lit(None).cast("string")
    for i, name in enumerate(names):
        alone = F.when(bad == 1 << i, F.lit(name)).otherwise(alone)
    return ledger(docs, RULES, id_col, text_col).withColumns({"base_failed": fails(BASE_POLICY), "kept": bad == 0, "policy": F.lit(policy.name), "only_failure": alone})


def keep_passing(docs: DataFrame, policy: Policy = POLICIES[-1], text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and with their columns, that the policy keeps. Every row is judged where it stands."""
    row = F.struct(*docs.columns)
    held = judged(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), policy, "_row", "_text")
    return held.where("kept").select("doc_id.*")
