"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. The tokens of each
cell, as the library counts them for a vocabulary, are summed in one
aggregation, the table of cells is raked until the token shares of each margin
are the targets, and each document is then kept with its cell's calibrated
probability, by a hash of its id and text: the same documents at every run, in
any order, without a shuffle of texts.

Every value of a margin is a cell's own, but for margins with given targets,
where values without one fall together. Up to ``most_cells`` cells are raked as
arrays on the driver, more as tables, joined with the factors of each margin;
both take the same steps. Probabilities are joined to the documents.

A share to keep bounds the probabilities at 1 while raking: a value whose target
is more than all of its tokens is kept whole, and what it lacks is shared among
the others of its margin in proportion to their targets.

Topics are what a document's words say: each topic has a list of words, and the
topic with the most hits in the text wins (ties: the first; no hit: ``other``).

Defined results: a null source or language is a value of its own; a document
without tokens weighs nothing and has its cell's probability; targets of values
that no document has are shared among the others in proportion; a cell that
cannot reach its margins gets as near as raking comes; repeated rows are kept
or dropped together; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, barrier, tidy
from .packing import Vocabulary, token_ids

OTHER = "other"
#: Stands for null, which no value is mistaken for.
NULL = "\0null"


@dataclass(frozen=True)
class Margin:
    """name: of a column of cells(), without its underscore. targets: share of the tokens by value; empty: the power-th roots of the present shares, which lifts rare values. most_values: without targets, all but so many largest values fall together; None: none do."""

    name: str
    targets: dict[str, float] = field(default_factory=dict)
    power: float = 1.0
    most_values: int | None = None


def with_topic(docs: DataFrame, text_col: str, topics: dict[str, list[str]], name: str = "_topic") -> DataFrame:
    """docs with the topic whose words stand most often in the text, as whole words in any case."""
    if not topics:
        return docs.withColumn(name, F.lit(OTHER))
    # each word's topic as a number, so that the text is gone through once; barriers as the words and hits are used several times
    number = {x.lower(): i for i, words in reversed(list(enumerate(topics.values()))) for x in words}
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+")
    df = barrier(docs, _hit=F.filter(words, lambda w: w.isin(list(number))))
    which = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    df = barrier(df, _hit=F.transform("_hit", lambda w: F.element_at(which, w)))
    hits = [F.size(F.filter("_hit", (lambda i: lambda x: x == i)(i))) for i in range(len(topics))]
    most, out = F.greatest(*hits, F.lit(0)), F.lit(OTHER)
    for i, topic in reversed(list(enumerate(topics))):
        out = F.when((hits[i] > 0) & (hits[i] == most), F.lit(topic)).otherwise(out)
    return df.withColumn(name, out).drop("_hit")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of cells with these tokens and codes of each margin such that the weighted token shares of every margin are its targets. Targets of values without tokens are shared among the others."""
    weight = np.ones(len(tokens))
    total = tokens.sum()
    if not total:
        return weight
    wanted = []
    for code, target in zip(codes, targets, strict=True):
        held = np.bincount(code, tokens, len(target)) > 0
        t = np.where(held, target, 0)
        wanted.append(t / t.sum() * total if t.sum() else np.bincount(code, tokens, len(target)))
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, wanted, strict=True):
            now = np.bincount(code, tokens * weight, len(target))
            ratio = np.divide(target, now, out=np.zeros(len(target)), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max() / total))
            weight = weight * ratio[code]
        if worst < tolerance:
            break
    return weight


def cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topics: dict[str, list[str]], tokens: Column | None = None) -> DataFrame:
    """docs, with _source, _lang, _topic and _tokens. Without a column of tokens the bytes of the text stand for them, a quarter each."""
    size = tokens if tokens is not None else F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    return with_topic(docs.withColumns({"_source": value(source_col), "_lang": value(lang_col), "_tokens": size.cast("double")}), text_col, topics)


def counted(celled: DataFrame, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """cells() with the library's number of tokens and without the text."""
    rest = [c for c in celled.columns if c not in (text_col, "_tokens")]

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            n = [len(token_ids(x.as_py() or "", vocabulary)) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n, pa.float64())], [*rest, "_tokens"])

    kinds = ", ".join(f"`{c}` {celled.schema[c].dataType.simpleString()}" for c in [*rest, "_tokens"])
    return celled.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("_text")).mapInArrow(tidy(made), kinds)


def _targets(margin: Margin, shares: dict[str, float]) -> dict[str, float]:
    if margin.targets:
        out = dict(margin.targets)
        missing = [v for v in shares if v not in out]
        if missing:
            out.setdefault(OTHER, max(0.0, 1 - sum(out.values())) or sum(shares[v] for v in missing))
        return out
    return {v: n**margin.power for v, n in shares.items()}


def attainable(tokens: np.ndarray, target: np.ndarray, most: float) -> np.ndarray:
    """Tokens to keep of each value: in proportion to the targets, at most all of a value's, as many as most together where the values with targets have them."""
    out, free = np.zeros(len(tokens)), (tokens > 0) & (target > 0)
    left = min(most, tokens[free].sum())
    while free.any():
        want = target * (left / target[free].sum())
        whole = free & (want >= tokens)
        if not whole.any():
            out[free] = want[free]
            break
        out[whole] = tokens[whole]
        left = max(left - tokens[whole].sum(), 0.0)
        free &= ~whole
    return out


def rake_within(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Probabilities of cells, at most 1, that keep this share of the tokens such that the kept tokens of every margin are the attainable() ones."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens))
    sums = [np.bincount(code, tokens, len(target)) for code, target in zip(codes, targets, strict=True)]
    most = min([keep * total, *(x[target > 0].sum() for x, target in zip(sums, targets, strict=True))])
    goals = [attainable(x, target, most) for x, target in zip(sums, targets, strict=True)]
    p = np.full(len(tokens), min(most / total, 1.0))
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, tokens * p, len(goal))
            whole = np.bincount(code, np.where(p >= 1, tokens, 0), len(goal))
            worst = max(worst, float(np.abs(now - goal).max() / total))
            # down: all cells of the value; up: those that are not kept whole yet
            up, rest = now < goal, now - whole
            down = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            lift = np.divide(goal - whole, rest, out=np.ones(len(goal)), where=rest > 1e-12 * total)
            p = np.minimum(np.where(up[code] & (p >= 1), 1.0, p * np.where(up, lift, down)[code]), 1.0)
        if worst < tolerance:
            break
    return p


def _table_goals(sums: DataFrame, most: float) -> DataFrame:
    """attainable() of a table (v, n, target): v, goal."""
    left, at = most, 0.0
    while True:
        # values whose target is at least their tokens at the ratio of the round before are whole
        row = sums.agg(F.sum(F.when(F.col("target") * at >= F.col("n"), F.col("n"))), F.sum(F.when(F.col("target") * at < F.col("n"), F.col("target")))).first()
        left = max(most - (row[0] or 0.0), 0.0)
        now = left / row[1] if row[1] else float("inf")
        if now <= at * (1 + 1e-12) or not row[1]:
            break
        at = now
    return sums.select("v", F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.col("n"), F.col("target") * F.lit(at))).alias("goal"))


def rake_table(cells: DataFrame, names: list[str], targets: list[DataFrame], keep: float | None, scratch: Scratch, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """rake_within(), or without a share to keep rake() and scale_for(), of a table of cells (names, n) with tables (v, n, target) of each margin: names, n, p."""
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    if not total:
        return cells.withColumn("p", F.lit(1.0))
    reach = [t.where("target > 0").agg(F.sum("n")).first()[0] or 0.0 for t in targets]
    most = min([keep * total, *reach]) if keep is not None else total
    goals = []
    for i, t in enumerate(targets):
        if keep is None:
            whole = t.where("n > 0").agg(F.sum("target")).first()[0] or 0.0
            goal = t.select("v", F.when(F.col("n") > 0, F.col("target") / F.lit(whole) * total).otherwise(0.0).alias("goal")) if whole else t.select("v", F.col("n").alias("goal"))
        else:
            goal = _table_goals(t, most)
        goals.append(scratch.table(f"goal{i}", goal))
    state, last = scratch.table("state", cells.withColumn("p", F.lit(min(most / total, 1.0)))), "state"
    for r in range(rounds):
        worst = 0.0
        for i, (c, goal) in enumerate(zip(names, goals, strict=True)):
            whole = F.when(F.col("p") >= 1, F.col("n")).otherwise(0.0) if keep is not None else F.lit(0.0)
            step = state.groupBy(F.col(c).alias("v")).agg(F.sum(F.col("n") * F.col("p")).alias("now"), F.sum(whole).alias("whole")).join(goal, "v")
            step = scratch.table(f"step{r}-{i}", step.withColumn("up", F.col("now") < F.col("goal")))
            worst = max(worst, step.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] / total)
            rest = F.col("now") - F.col("whole")
            lift = F.when(rest > 1e-12 * total, (F.col("goal") - F.col("whole")) / rest).otherwise(1.0)
            down = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
            ratio = step.select(F.col("v").alias(c), "up", (F.when(F.col("up"), lift).otherwise(down) if keep is not None else down).alias("ratio"))
            p = F.col("p") * F.col("ratio")
            if keep is not None:
                p = F.when(F.col("up") & (F.col("p") >= 1), 1.0).otherwise(F.least(p, F.lit(1.0)))
            state = scratch.table(f"state{r}-{i}", state.join(ratio, c).select(*names, "n", p.alias("p")))
            scratch.drop(last, f"step{r}-{i}")
            last = f"state{r}-{i}"
        if worst < tolerance:
            break
    if keep is None:
        highest = state.where("n > 0").agg(F.max("p")).first()[0] or 1.0
        state = state.withColumn("p", F.least(F.col("p") / F.lit(highest), F.lit(1.0)))
    return state


@dataclass
class Mixture:
    """Calibrated probabilities by cell, a table (_cell0, .., n, p); values says how each margin's values fall together, None: they don't."""

    margins: list[Margin]
    values: list[list[str] | None]
    #: None: of every value the power-th root of its share.
    targets: list[dict[str, float] | None]
    fitted: DataFrame
    few: bool

    def folded(self) -> list[Column]:
        return [F.col(f"_{m.name}") if v is None else F.when(F.col(f"_{m.name}").isin(*v), F.col(f"_{m.name}")).otherwise(F.lit(OTHER)) if v else F.lit(OTHER) for m, v in zip(self.margins, self.values, strict=True)]

    def with_probability(self, celled: DataFrame) -> DataFrame:
        """cells() with _probability: that a document is kept."""
        names = [f"_cell{i}" for i in range(len(self.margins))]
        table = self.fitted.select(*names, F.col("p").alias("_p"))
        out = celled.withColumns(dict(zip(names, self.folded(), strict=True))).join(F.broadcast(table) if self.few else table, names, "left")
        return out.withColumn("_probability", F.coalesce("_p", F.lit(0.0))).drop("_p", *names)

    @cached_property
    def shares(self) -> list[dict[str, tuple[float, float, float]]]:
        """For each margin, value: (share before, target, share in expectation). Gathers the values of the margins."""
        out = []
        for i, m in enumerate(self.margins):
            rows = self.fitted.groupBy(f"_cell{i}").agg(F.sum("n"), F.sum(F.col("n") * F.col("p"))).collect()
            before, after = sum(r[1] for r in rows) or 1.0, sum(r[2] for r in rows) or 1.0
            goal = {r[0]: (r[1] / before) ** m.power if self.targets[i] is None else self.targets[i].get(r[0], 0.0) for r in rows}
            whole = sum(goal.values()) or 1.0
            out.append({r[0]: (r[1] / before, goal[r[0]] / whole, r[2] / after) for r in rows})
        return out


def scale_for(tokens: np.ndarray, weight: np.ndarray) -> float:
    """What the weights are multiplied by to be probabilities: the most at which none is cut at 1."""
    held = weight[(tokens > 0) & (weight > 0)]
    return float(1 / held.max()) if len(held) else 1.0


def fit(celled: DataFrame, margins: list[Margin], keep: float | None = None, most_cells: int = 500_000) -> Mixture:
    """Rakes the tokens of the cells. keep: the share of all tokens to keep in expectation; None: the most at which no cell would need a probability over 1."""
    columns, names = [f"_{m.name}" for m in margins], [f"_cell{i}" for i in range(len(margins))]
    # one look at the texts; margins and cells of folded values come from its table
    scratch = Scratch(celled.sparkSession, "mixing")
    celled = scratch.table("cells", celled.groupBy(*columns).agg(F.sum("_tokens").alias("_tokens")))
    total = celled.agg(F.sum("_tokens")).first()[0] or 0.0
    values, targets = [], []
    for m, c in zip(margins, columns, strict=True):
        if not m.targets and m.most_values is None:
            values.append(None)
            targets.append(None)
            continue
        wanted = F.col(c).isin(*m.targets) if m.targets else F.lit(True)
        top = celled.groupBy(c).agg(F.sum("_tokens").alias("n")).where(wanted).orderBy(F.desc("n"), c).limit(len(m.targets) or m.most_values).collect()  # bounded by the margin
        shares = {r[0]: r[1] / total if total else 0.0 for r in top}
        rest = 1 - sum(shares.values())
        if rest > 1e-12 and total:
            shares["\0rest"] = rest
        out = _targets(m, shares)
        if "\0rest" in out:
            out[OTHER] = out.get(OTHER, 0) + out.pop("\0rest")
        values.append([v for v in out if v != OTHER or v in shares])
        targets.append(out)
    mixture = Mixture(margins, values, targets, celled, True)
    folded = scratch.table("folded", celled.groupBy(*[f.alias(n) for n, f in zip(names, mixture.folded(), strict=True)]).agg(F.sum("_tokens").alias("n")))
    mixture.few = folded.count() <= most_cells
    if mixture.few:
        rows = folded.toPandas()  # at most most_cells
        tokens = rows["n"].to_numpy(float)
        coded = [np.unique(rows[n].to_numpy(str), return_inverse=True) for n in names]
        codes = [c for _, c in coded]
        goals = [(np.bincount(c, tokens, len(v)) / (total or 1.0)) ** m.power if t is None else np.array([t.get(x, 0.0) for x in v.tolist()]) for m, t, (v, c) in zip(margins, targets, coded, strict=True)]
        if keep is None:
            weight = rake(tokens, codes, goals)
            p = np.minimum(weight * scale_for(tokens, weight), 1.0)
        else:
            p = rake_within(tokens, codes, goals, keep)
        fitted = celled.sparkSession.createDataFrame(rows.assign(p=p), f"{', '.join(f'{n} string' for n in names)}, n double, p double")
    else:
        goals = []
        for i, (m, t, n) in enumerate(zip(margins, targets, names, strict=True)):
            sums = folded.groupBy(F.col(n).alias("v")).agg(F.sum("n").alias("n"))
            if t is None:
                target = F.pow(F.col("n") / F.lit(total or 1.0), F.lit(m.power))
            else:
                target = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in t.items() for x in (pair[0], float(pair[1]))]), F.col("v")), F.lit(0.0))
            goals.append(scratch.table(f"margin{i}", sums.withColumn("target", target)))
        fitted = rake_table(folded, names, goals, keep, scratch)
    mixture.fitted = scratch.table("fitted", fitted)
    return mixture


def uniform(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) that belongs to the document."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, margins: list[Margin], topics: dict[str, list[str]], keep: float | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", vocabulary: Vocabulary | None = None, most_cells: int = 500_000) -> tuple[DataFrame, Mixture]:
    """id_col of every row, the columns of cells(), _probability and _kept; and the mixture. Texts are read once."""
    named = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"), uniform(id_col, text_col, seed).alias("_draw"))
    celled = cells(named, "t", "s", "l", topics).drop("s", "l")
    celled = counted(celled, "t", vocabulary) if vocabulary else celled.drop("t")
    celled = Scratch(docs.sparkSession, "mixing").table("documents", celled)
    mixture = fit(celled, margins, keep, most_cells)
    return mixture.with_probability(celled).withColumn("_kept", F.col("_draw") < F.col("_probability")).withColumnRenamed("i", id_col).drop("_draw"), mixture


def sample(docs: DataFrame, margins: list[Margin], topics: dict[str, list[str]], keep: float | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", vocabulary: Vocabulary | None = None) -> DataFrame:
    """The kept rows of docs, whole, whatever their columns are called."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"))
    celled = cells(packed, "t", "s", "l", topics)
    bare = cells(packed.drop("row"), "t", "s", "l", topics).drop("i", "s", "l")
    mixture = fit(counted(bare, "t", vocabulary) if vocabulary else bare, margins, keep)
    return mixture.with_probability(celled).where(uniform("i", "t", seed) < F.col("_probability")).select("row.*")
