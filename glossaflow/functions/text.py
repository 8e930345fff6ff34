"""Small functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming removes, the marks around a translation, and the tags that stand for JSON punctuation.
TRIMMED = " \t\n\r\0\x0b"
START, END = "‹‹TRANSLATION››", "‹‹END››"
JSON_TAGS = {"{": "<jlc/>", "}": "<jrc/>", "[": "<jlb/>", "]": "<jrb/>", ":": "<jcol/>", ",": "<jcomma/>", '"': "<jqt/>"}


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def wrap(text: Column) -> Column:
    """A text between the marks, on lines of their own."""
    return F.concat(F.lit(START + "\n"), text, F.lit("\n" + END))


def has_marks(text: Column) -> Column:
    return text.rlike(f"(?s)\\Q{START}\\E.*?\\Q{END}\\E")


def unwrap(text: Column) -> Column:
    """What stands from the first START to the next END, trimmed; null without both."""
    return F.when(has_marks(text), trimmed(F.regexp_extract(text, f"(?s)\\Q{START}\\E(.*?)\\Q{END}\\E", 1)))


def tag_json(text: Column) -> Column:
    """JSON punctuation as tags. No tag holds a character that is replaced, so one after another is as good as all at once."""
    for char, tag in JSON_TAGS.items():
        text = F.replace(text, F.lit(char), F.lit(tag))
    return text


def untag_json(text: Column) -> Column:
    for char, tag in JSON_TAGS.items():
        text = F.replace(text, F.lit(tag), F.lit(char))
    return text


def form_encoded(value: Column) -> Column:
    """As in a form's body: space is +, and everything but letters, digits, - . _ is escaped."""
    return F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))


def form_body(fields: list[tuple[str, Column]]) -> Column:
    """name=value pairs joined by &; null values are left out."""
    return F.concat_ws("&", *[F.concat(F.lit(name + "="), form_encoded(value)) for name, value in fields])


def masked(text: Column, secrets: list[str]) -> Column:
    """text with each secret as ***, one after another; empty secrets have no effect."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} of values replaced. The template is cut on the driver, so values are never looked through for names; unknown names stay."""
    parts: list[Column] = []
    rest = template
    while rest:
        at, name = min(((i, n) for n in values for i in [rest.find("{" + n + "}")] if i >= 0), default=(-1, ""))
        if at < 0:
            break
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    if rest or not parts:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def pairs(text: Column) -> Column:
    """name=value,name=value as a map, trimmed, the last of a name wins; null if a pair has no =."""
    made = F.transform(F.split(text, ",", -1), lambda p: F.struct(trimmed(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), trimmed(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)))).alias("v")))
    good = F.forall(made, lambda x: x["v"].isNotNull())
    last = F.aggregate(made, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return F.when(text.isNull() | (text == ""), F.create_map().cast("map<string,string>")).when(good, last)


def names(text: Column) -> Column:
    """A comma-separated list as an array of trimmed names."""
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ",", -1), trimmed))
