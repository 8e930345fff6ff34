"""Whether JSON and HTML are well formed, and whether two JSON texts have the same structure.

These three need a parser per text, so they are Arrow-batched functions; all
else of the package is native.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the deepest nesting of lists and objects.
MOST_DEPTH = 512
RESULT = "struct<valid: boolean, errors: array<string>>"


#: What a value comes to: the signature of its structure, and how deep it is nested.
_NULL, _BOOLEAN, _INTEGER, _DOUBLE, _STRING = (("NULL", 0), ("boolean", 0), ("integer", 0), ("double", 0), ("string", 0))


def _integer(digits: str) -> tuple[str, int]:
    """By its digits; numbers of any length are never made. A negative zero has no integer."""
    if len(digits) < 19 and digits != "-0":
        return _INTEGER
    size, last = len(digits.lstrip("-")), str(2**63 if digits[0] == "-" else 2**63 - 1)
    return _INTEGER if digits != "-0" and (size < len(last) or size == len(last) and digits.lstrip("-") <= last) else _DOUBLE


def _refused(name: str):
    raise ValueError(f"{name} is no JSON value")


def _of(value, look: bool) -> tuple[str, int]:
    """What a value comes to that the decoder has just made: objects have come to it already, lists hold what they do. look: whether strings may have half a surrogate pair."""
    kind = type(value)
    if kind is tuple:
        return value
    if kind is str:
        if look:
            value.encode()
        return _STRING
    if kind is list:
        held = [_of(x, look) for x in value]
        return "[" + ",".join([x for x, _ in held]) + "]", 1 + max([d for _, d in held], default=0)
    return _NULL if value is None else _BOOLEAN


def _object(members: list, look: bool) -> tuple[str, int]:
    held: dict = {}
    for name, value in members:
        if look:
            name.encode()
        held[name] = _of(value, look)
    depth = 1 + max([d for _, d in held.values()], default=0)
    if list(held) == [str(i) for i in range(len(held))]:
        return "[" + ",".join([x for x, _ in held.values()]) + "]", depth
    return "{" + ",".join([json.dumps(k) + ":" + x for k, (x, _) in held.items()]) + "}", depth


def _decoder(look: bool) -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=lambda x: _object(x, look), parse_int=_integer, parse_float=lambda _: _DOUBLE, parse_constant=_refused)


_DECODERS = _decoder(False), _decoder(True)


def json_checked_text(text: str) -> tuple[str | None, str | None]:
    """(why a text is no JSON, None) or (None, the signature of its structure), by one scan that keeps no tree.

    The signature has objects with their names in order, the last value of a name
    at the place of its first, lists element by element, and kinds of values. An
    empty object is an empty list, and so is an object with the names 0, 1, 2, … a
    list.
    """
    look = "\\u" in text
    try:
        made, depth = _of(_DECODERS[look].decode(text), look)
        if depth > MOST_DEPTH:
            raise ValueError("nested too deep")
    except UnicodeEncodeError:
        return "not well-formed JSON: lone surrogate", None
    except RecursionError:
        return "not well-formed JSON: nested too deep", None
    except ValueError as e:
        return f"not well-formed JSON: {e}", None
    return None, made


def json_error(text: str) -> str | None:
    """Why a text is no JSON, or None."""
    return json_checked_text(text)[0]


def signature(text: str) -> str | None:
    """The structure of a JSON text, or None if it is no JSON."""
    return json_checked_text(text)[1]


#: Fixed values of HTML: elements without an end tag, and those whose end tag may be left out.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont frame isindex".split())
_OPTIONAL_END = frozenset("p li dt dd option optgroup thead tbody tfoot tr td th colgroup body html head".split())
#: Fixed values of HTML: what a start tag ends by itself if it is the innermost open element.
_ENDS = {
    "p": "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split(),
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option", "optgroup"], "optgroup": ["optgroup"], "td": ["td", "th", "tr", "tbody", "tfoot"], "th": ["td", "th", "tr", "tbody", "tfoot"],
    "tr": ["tr", "tbody", "tfoot"], "thead": ["tbody", "tfoot"], "tbody": ["tbody", "tfoot"], "tfoot": ["tbody"], "colgroup": ["thead", "tbody", "tfoot", "tr", "td"], "head": ["body"],
}
_ENDED = {tag: frozenset(k for k, v in _ENDS.items() if tag in v) for tag in {x for v in _ENDS.values() for x in v}}
#: Fixed values of HTML: elements that hold cells only through others, and what may stand in them; all else a browser puts before the table.
_TABLE = frozenset("table thead tbody tfoot tr".split())
_IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th script style template form input".split())
#: Fixed value: the pattern of a whole document's begin.
FULL_DOCUMENT = r"(?i)^\s*<(?:!DOCTYPE|html)(\s|>)"


class _Checker(HTMLParser):
    """The open elements of a page, from the outermost, and what is wrong with its tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.errors: list[str] = []
        self.ids: set[str | None] = set()

    def handle_starttag(self, tag, attrs):
        if "<" in (self.get_starttag_text() or "")[1:]:
            self.errors.append(f"tag {tag} is not closed by >")
        names = [k for k, _ in attrs]
        for name in {n for n in names if names.count(n) > 1}:
            self.errors.append(f"attribute {name} of {tag} is given twice")
        for name in {n for n in names if re.search("[\"'=]", n)}:
            self.errors.append(f"attribute {name} of {tag} has a name that is none")
        held = dict(attrs).get("id")
        if held is not None and held in self.ids:
            self.errors.append(f"id {held} is given twice")
        self.ids.add(held)
        while self.open and self.open[-1] in _ENDED.get(tag, ()):
            self.open.pop()
        if self.open and self.open[-1] in _TABLE and tag not in _IN_TABLE:
            self.errors.append(f"{tag} stands in {self.open[-1]}, outside of a cell")
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag not in self.open:
            self.errors.append(f"end tag {tag} closes nothing")
            return
        while self.open:
            last = self.open.pop()
            if last == tag:
                break
            if last not in _OPTIONAL_END:
                self.errors.append(f"end tag {tag} comes before that of {last}")

    def handle_data(self, data):
        if self.cdata_elem is None:
            if re.search(r"<(?![A-Za-z/!?])", data):
                self.errors.append("a < that begins no tag")
            if self.open and self.open[-1] in _TABLE and not data.isspace():
                self.errors.append(f"text stands in {self.open[-1]}, outside of a cell")

    def handle_entityref(self, name):
        self.handle_data(name)

    def handle_charref(self, name):
        self.handle_data(name)


_REFERENCE = re.compile(r"<!--|<(script|style)(?=[\s/>])|&(?:(#(?:[xX][0-9A-Fa-f]+|[0-9]+))|(#?[A-Za-z][A-Za-z0-9]*))?(;?)", re.I)


def reference_errors(text: str) -> list[str]:
    """What is wrong with character references, in texts and attributes, outside of comments, scripts and styles."""
    out, at = [], 0
    while m := _REFERENCE.search(text, at):
        at = m.end()
        if m[0] == "<!--" or m[1]:
            ends = re.compile("-->" if m[0] == "<!--" else f"</{m[1]}", re.I).search(text, at)
            if not ends:
                break
            at = ends.end()
        elif m[2] is None and m[3] is None:
            out.append("a & that begins no reference")
        elif not m[4]:
            out.append(f"reference &{m[2] or m[3]} is not ended by ;")
        elif m[3] and m[3] + ";" not in html5:
            out.append(f"reference &{m[3]}; is not known")
    return out


def html_errors(text: str) -> list[str]:
    """What is wrong in an HTML document or fragment: broken tags and attributes, end tags that don't match, what stands in a table outside of its cells, doubled attributes and ids, character references. Names of elements are free. An approximation of a parser's error list, from the tags in their order; no tree is made."""
    checker = _Checker()
    try:
        checker.feed(text if re.match(FULL_DOCUMENT, text, re.A) else f"<div>{text}</div>")
        rest = checker.rawdata
        checker.close()
    except AssertionError as e:
        return [str(e)]
    if rest.startswith("<") and len(rest) > 1:
        checker.errors.append("the last tag has no end")
    checker.errors += [f"{tag} is not ended" for tag in reversed(checker.open) if tag not in _OPTIONAL_END]
    return checker.errors + reference_errors(text)


def is_full_document(text: Column) -> Column:
    """Whether a text is a whole HTML document and not a fragment."""
    return text.rlike(FULL_DOCUMENT)


def _batched(function, kind: str):
    """An Arrow-batched column function; null in, null out."""

    @F.pandas_udf(kind)
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return made


@cache
def _json_scan():
    """One function object, so that Spark sees equal calls as one."""

    @F.arrow_udf("struct<error: string, signature: string>")
    def scanned(texts: pa.Array) -> pa.Array:
        held = [(None, None) if x is None else json_checked_text(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([e for e, _ in held], pa.string()), pa.array([s for _, s in held], pa.string())], ["error", "signature"])

    return scanned


def json_scan(text: Column) -> Column:
    """struct(error, signature) by one scan of each text; both null for a null text."""
    return _json_scan()(text)


def scan_result(text: Column, scan: Column) -> Column:
    """struct(valid, errors) from a scan."""
    error = scan["error"]
    return F.when(text.isNotNull(), F.struct(error.isNull().alias("valid"), F.when(error.isNull(), F.array().cast("array<string>")).otherwise(F.array(error)).alias("errors")))


def json_result(text: Column) -> Column:
    """struct(valid, errors)."""
    return scan_result(text, json_scan(text))


def html_result(text: Column) -> Column:
    errors = _batched(html_errors, "array<string>")(text)
    return F.when(text.isNotNull(), F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors")))


def json_signature(text: Column) -> Column:
    return json_scan(text)["signature"]


def same_structure(before: Column, after: Column) -> Column:
    """Over two signatures: struct(valid, errors)."""
    same = before.eqNullSafe(after)
    return F.struct(same.alias("valid"), F.when(same, F.array().cast("array<string>")).otherwise(F.array(F.lit("the structure has changed"))).alias("errors"))


def _passes(text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(F.lit(True).alias("valid"), F.array().cast("array<string>").alias("errors")))


#: Asked by format for struct(valid, errors) of a text column; add an own format's validator here.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"json": json_result, "html": html_result}


def container_result(text: Column, format_name: str) -> Column:
    """By format: json, html and what has been added are checked, all else passes."""
    return VALIDATORS.get(format_name, _passes)(text)
