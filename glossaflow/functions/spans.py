"""Spans that must not change: replaced by numbered placeholders before a call, and put back after it.

A filter is a regular expression, or takes elements of HTML. Filters run one
after another over the whole column; each match becomes ``@@n@@``, and n goes on
counting through all filters of a document. What a filter took is kept as an
array in order of the numbers, so a later span may hold an earlier placeholder,
and putting back runs from the last filter to the first. Null texts stay null.

Elements are matched in time linear in the text, whatever it holds: the text is
cut at end tags, and of each piece only the first opening counts. Putting back
is one pass a filter too: the text is cut at placeholders, each is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern of addresses and the form of placeholders. The look-behind stands for a word border between ASCII characters.
URL_PATTERN = r'(?i)(?<![A-Za-z0-9_])(?:https?|ftp|mailto)://[^\s"<>()]+'
MARK = "@@"


@dataclass(frozen=True)
class SpanFilter:
    """What matches pattern; with tag, the elements of that name, as pattern says them: from the first opening to the next end tag after a >."""

    name: str
    pattern: str
    tag: str = ""


def _url(name: str) -> SpanFilter | None:
    return SpanFilter(name, URL_PATTERN) if name == "url" else None


#: Names of elements that are matched by pieces: letters, digits, and sets of them. Other expressions are matched as they are.
_PLAIN_TAG = re.compile(r"(?:[\w:.-]|\[[\w-]+\])+", re.ASCII)


def _html_element(name: str) -> SpanFilter | None:
    """html_TAG takes elements from the first opening to the first end tag; TAG is a regular expression itself."""
    tag = name.removeprefix("html_")
    return SpanFilter(name, f"(?is)<{tag}.*?>.*?</{tag}>", tag if _PLAIN_TAG.fullmatch(tag) else "") if name.startswith("html_") else None


#: Asked in turn for a filter of a name; register further kinds by adding to it.
FACTORIES: list[Callable[[str], SpanFilter | None]] = [_url, _html_element]


def resolve(names: Iterable[str]) -> list[SpanFilter]:
    """The filters of these names, in order, duplicates too; unknown names have no effect."""
    return [made for name in names for made in [next(filter(None, (f(name) for f in FACTORIES)), None)] if made]


def parse_names(listed: str | None) -> list[str]:
    """Names from a comma-separated list."""
    return [x.strip(" \t\n\r\0\x0b") for x in listed.split(",")] if listed else []


def _taken(text: Column, made: SpanFilter) -> Column:
    return F.regexp_extract_all(text, F.lit(made.pattern), F.lit(0))


def _numbered(text: Column, made: SpanFilter, before: Column) -> Column:
    parts = F.split(text, made.pattern, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(MARK), (before + i - 1).cast("string"), F.lit(MARK), x))), "")


def _mark(n: Column) -> Column:
    return F.concat(F.lit(MARK), n.cast("string"), F.lit(MARK))


def _with_elements(df: DataFrame, text: Column, made: SpanFilter, before: Column, k: int) -> DataFrame:
    """df with _m{k}, the elements, and _t{k}, the text with placeholders for them.

    Pieces lie between end tags. The first opening of a piece takes all up to the
    piece's end tag, if a > stands between them; if none does, the > is that of the
    end tag, and the element ends with the next piece. Later openings of a piece lie
    within the element of the first, or lack the > as well.
    """
    col = lambda x: F.col(f"_{x}{k}")
    end = f"(?i)</{made.tag}>"
    df = df.withColumns({f"_p{k}": F.split(text, end, -1), f"_e{k}": F.regexp_extract_all(text, F.lit(end), F.lit(0))})
    df = df.withColumn(f"_o{k}", F.transform(col("p"), lambda p: F.regexp_extract(p, f"(?is)<{made.tag}.*", 0)))
    # n: no opening, o: an element, g: an opening without >; the last piece has no end tag
    kind = lambda o, i: F.when(i == F.size(col("e")), "z").when(o == "", "n").when(o.contains(">"), "o").otherwise("g")
    kinds = F.array_join(F.transform(col("o"), kind), ",")
    # what a g opens ends with the piece after it, which opens nothing itself
    df = df.withColumn(f"_k{k}", F.split(F.regexp_replace(kinds, "g,[nog]", "s,c"), ","))
    places = F.filter(F.sequence(F.lit(0), F.size(col("e"))), lambda i: F.get(col("k"), i).isin("o", "s"))
    ended = lambda i: F.concat(F.get(col("p"), i), F.coalesce(F.get(col("e"), i), F.lit("")))
    df = df.withColumns({f"_x{k}": places, f"_l{k}": F.transform(F.sequence(F.lit(0), F.size(col("e"))), ended)})
    goes_on = lambda i: F.get(col("k"), i) == "s"
    element = lambda i: F.concat(F.get(col("o"), i), F.get(col("e"), i), F.when(goes_on(i), F.get(col("l"), i + 1)).otherwise(""))
    # the first piece after an element, and after none
    after = lambda i: F.coalesce(i + F.when(goes_on(i), 2).otherwise(1), F.lit(0))
    joined = lambda begin, stop: F.array_join(F.slice(col("l"), begin + 1, stop - begin), "")

    def part(i: Column, j: Column) -> Column:
        own = F.get(col("p"), i)
        return F.concat(joined(after(F.get(col("x"), j - 1)), i), F.substr(own, F.lit(1), F.length(own) - F.length(F.get(col("o"), i))), _mark(before + j))

    rest = joined(after(F.get(col("x"), F.size(col("x")) - 1)), F.size(col("l")))
    whole = F.concat(F.array_join(F.transform(col("x"), part), ""), rest)
    return df.withColumns({f"_m{k}": F.transform(col("x"), element), f"_t{k}": F.when(F.size(col("x")) > 0, whole).otherwise(text)})


def protect(df: DataFrame, text_col: str, filters: list[SpanFilter], prepared_col: str = "prepared", spans_col: str = "spans") -> DataFrame:
    """df with the prepared text, and spans: for each filter its name, the number of its first placeholder, and what it took."""
    text, before = F.col(text_col), F.lit(0)
    steps = []
    # a column for each step: expressions stay small, and nothing is computed twice
    for k, made in enumerate(filters):
        if made.tag:
            df = _with_elements(df, text, made, before, k)
        else:
            df = df.withColumn(f"_m{k}", _taken(text, made))
            df = df.withColumn(f"_t{k}", _numbered(text, made, before))
        df = df.withColumn(f"_b{k + 1}", before + F.size(f"_m{k}"))
        steps.append(F.struct(F.lit(made.name).alias("filter"), before.cast("int").alias("first"), F.col(f"_m{k}").alias("found")))
        text, before = F.col(f"_t{k}"), F.col(f"_b{k + 1}")
    kind = "array<struct<filter: string, first: int, found: array<string>>>"
    spans = F.array(*steps).cast(kind) if steps else F.array().cast(kind)
    df = df.withColumns({prepared_col: text, spans_col: F.when(F.col(text_col).isNotNull(), spans)})
    return df.drop(*[f"_{x}{k}" for k in range(len(filters) + 1) for x in "mtbpeokxl"])


def _marked(found: Column, first: Column) -> Column:
    """Each span with its placeholder."""
    return F.transform(found, lambda v, i: F.struct(F.concat(F.lit(MARK), (first + i).cast("string"), F.lit(MARK)).alias("mark"), v.alias("span")))


#: Two placeholders that share a character: which of them counts depends on their numbers.
_SHARED = f"{MARK}[0-9]+{MARK}@?[0-9]+{MARK}"
#: A span that may make a placeholder with what stands beside it, or has two that share a character.
_JOINING = rf"{_SHARED}|{MARK}[0-9]+@?\z|\A@?[0-9]+@|\A[@0-9]*\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(digits: Column) -> Column:
    return digits.try_cast("bigint")


def _folded(text: Column, step: Column) -> Column:
    """One replacement after another: what placeholders that share characters are defined by."""
    return F.aggregate(_marked(step["found"], step["first"]), text, lambda acc, e: F.replace(acc, e["mark"], e["span"]))


def _in_one_pass(text: Column, step: Column) -> Column:
    digits = F.regexp_extract_all(text, F.lit(f"{MARK}([0-9]+){MARK}"), F.lit(1))

    def opened(held: Column) -> Column:
        def with_span(part: Column, i: Column) -> Column:
            d = F.get(held, i - 1)
            at = _number(d) - step["first"]
            # a number is written in one way only
            own = F.when((_number(d).cast("string") == d) & (at >= 0) & (at < F.size(step["found"])), F.get(step["found"], at.cast("int")))
            return F.when(i == 0, part).otherwise(F.concat(F.coalesce(own, F.concat(F.lit(MARK), d, F.lit(MARK))), part))

        return F.array_join(F.transform(F.split(text, f"{MARK}[0-9]+{MARK}", -1), with_span), "")

    return let(digits, opened)


def _run_together(text: Column, step: Column) -> Column:
    """Whether the order of replacements matters: placeholders share characters, or a span has or makes one of its own filter."""
    own = lambda s: F.exists(F.regexp_extract_all(s, F.lit(f"{MARK}([0-9]+){MARK}"), F.lit(1)), lambda d: F.coalesce(_number(d) >= step["first"], F.lit(False)))
    return text.rlike(_SHARED) | F.exists(step["found"], lambda s: s.rlike(_JOINING) | own(s))


def _put_back(text: Column, step: Column) -> Column:
    """text with the spans of one filter."""

    def opened(t: Column) -> Column:
        nothing = step.isNull() | (F.size(step["found"]) == 0) | ~t.contains(MARK)
        return F.when(nothing, t).when(_run_together(t, step), _folded(t, step)).otherwise(_in_one_pass(t, step))

    return let(text, opened)


def restore(text: Column, spans: Column, n_filters: int) -> Column:
    """text with the spans put back: from the last filter to the first, within a filter each wherever its placeholder stands."""
    for k in reversed(range(n_filters)):
        text = _put_back(text, spans[k])
    return text


def stats(spans: Column) -> Column:
    """How many spans each filter took, in the order of the filters."""
    return F.transform(spans, lambda s: F.struct(s["filter"].alias("filter"), F.size(s["found"]).cast("bigint").alias("count")))


def holds_marks(text: Column) -> Column:
    """Whether a text has something like a placeholder before any is made: such texts may not come back unchanged."""
    return text.rlike(f"{MARK}[0-9]+{MARK}")
