"""Responses of the services to struct(text, usage, error), natively on VARIANT.

usage is the service's own usage object, or null. error is null or
struct(code, message); the ladder of each service goes from the body's form
over the service's own errors to the missing marks. A body is decoded once, and
so is what stands at a path that several steps look at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.spans import let


def decoded(body: Column) -> Column:
    """VARIANT, null if the body is no JSON."""
    return F.try_parse_json(body)


def at(data: Column, path: str) -> Column:
    """The part at a path as VARIANT; null if it is missing or null."""
    found = F.try_variant_get(data, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def kind(part: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, …"""
    return F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0)


def string_at(data: Column, path: str) -> Column:
    """The string at a path; null if it is anything else."""
    return let(F.try_variant_get(data, path, "variant"), lambda part: F.when(kind(part) == "STRING", F.try_variant_get(part, "$", "string")))


def said_at(data: Column, path: str) -> Column:
    """What stands at a path as text: strings as they are, other parts as JSON."""
    return let(at(data, path), lambda part: F.when(kind(part) == "STRING", F.try_variant_get(part, "$", "string")).otherwise(F.to_json(part)))


def is_container(data: Column) -> Column:
    return data.isNotNull() & kind(data).isin("OBJECT", "ARRAY")


Step = tuple[Column, str, Column]


def _ladder(steps: list[Step]) -> Column:
    """The first step whose condition holds, as struct(code, message)."""
    out = None
    for condition, code, message in steps:
        made = F.struct(F.lit(code).alias("code"), message.alias("message"))
        out = F.when(condition, made) if out is None else out.when(condition, made)
    return out


def _result(said: Column, usage: Column, ladder: Callable[[Column], list[Step]], marked: bool = True) -> Column:
    """said: the content, which is found once. ladder: the steps over it."""

    def judged(content: Column) -> Column:
        lost = (~F.coalesce(tx.has_marks(content), F.lit(False)), "no_marks", F.lit("the marks around the translation are missing"))
        text = tx.unwrap(content) if marked else content
        steps = [*ladder(content), lost] if marked else ladder(content)
        return let(_ladder(steps), lambda error: F.struct(F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), usage).alias("usage"), error.alias("error")))

    return let(said, judged)


def _of_decoded(parser: Callable[[Column, Column, dict], Column]) -> Callable[[Column, dict], Column]:
    """A parser (data, body, settings) as one of the body and settings; the body is decoded once, not for each look at it."""

    @wraps(parser)
    def made(body: Column, settings: dict) -> Column:
        return let(decoded(body), lambda data: parser(data, body, settings))

    return made


def _malformed(data: Column, body: Column) -> Step:
    return ~F.coalesce(is_container(data), F.lit(False)), "invalid_json", F.concat(F.lit("the response is no JSON object: "), body)


_TRUNCATED = "the answer was cut off; allow more tokens or split the text"


@_of_decoded
def anthropic(data: Column, body: Column, settings: dict) -> Column:
    said, problem = string_at(data, "$.choices[0].message.content"), at(data, "$.error")
    message = F.coalesce(said_at(data, "$.error.message"), said_at(data, "$.error"))
    asked = (settings.get("defaults") or {}).get("max_tokens")
    ladder = lambda content: [
        _malformed(data, body),
        (problem.isNotNull() & F.contains(message, F.lit("max_tokens")), "too_many_tokens", F.concat(F.lit(f"the service refuses {asked} tokens for an answer: "), message)),
        (problem.isNotNull(), "api_error", message),
        (F.coalesce(string_at(data, "$.choices[0].finish_reason") == "length", F.lit(False)), "truncated", F.lit(_TRUNCATED)),
        (F.coalesce(content, F.lit("")) == "", "empty", F.concat(F.lit("no translation: "), body)),
    ]
    return _result(said, at(data, "$.usage"), ladder)


@_of_decoded
def openai(data: Column, body: Column, settings: dict) -> Column:
    said = string_at(data, "$.choices[0].message.content")
    ladder = lambda content: [
        _malformed(data, body),
        (F.coalesce(string_at(data, "$.choices[0].finish_reason") == "length", F.lit(False)), "truncated", F.lit(_TRUNCATED)),
        (F.coalesce(content, F.lit("")) == "", "empty", F.concat(F.lit("no translation: "), body)),
    ]
    return _result(said, at(data, "$.usage"), ladder)


@_of_decoded
def xai(data: Column, body: Column, settings: dict) -> Column:
    """Never looks whether the answer was cut off."""
    said = string_at(data, "$.choices[0].message.content")
    code = F.coalesce(said_at(data, "$.code"), F.lit("unknown_error"))
    ladder = lambda content: [
        _malformed(data, body),
        (at(data, "$.error").isNotNull(), "api_error", F.concat(F.lit("["), code, F.lit("] "), said_at(data, "$.error"))),
        (content.isNull(), "empty", F.concat(F.lit("no translation: "), body)),
    ]
    return _result(said, at(data, "$.usage"), ladder)


@_of_decoded
def google(data: Column, body: Column, settings: dict) -> Column:
    reason = F.coalesce(said_at(data, "$.candidates[0].finishReason"), F.lit(""))
    parts = at(data, "$.candidates[0].content.parts")
    pieces = F.try_variant_get(parts, "$", "array<variant>")
    texts = F.transform(pieces, lambda p: F.when(F.regexp_extract(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")), "^[A-Z]+", 0) == "STRING", F.try_variant_get(p, "$.text", "string")))
    said = F.array_join(texts, "")  # nulls are left out
    ladder = lambda content: [
        _malformed(data, body),
        (reason == "MAX_TOKENS", "truncated", F.lit(_TRUNCATED)),
        (reason != "STOP", "unexpected_finish", F.concat(F.lit("the answer ended with '"), reason, F.lit("': "), body)),
        (~F.coalesce(kind(parts).isin("ARRAY", "OBJECT"), F.lit(False)), "empty", F.concat(F.lit("no translation: "), body)),
    ]
    return _result(said, at(data, "$.usageMetadata"), ladder)


@_of_decoded
def yandex(data: Column, body: Column, settings: dict) -> Column:
    problem = at(data, "$.error")
    message = F.coalesce(said_at(data, "$.error.message"), said_at(data, "$.error"))
    code = F.when(kind(at(data, "$.error.httpCode")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(data, "$.error.httpCode", "int"))
    status = F.coalesce(F.lower(string_at(data, "$.error.httpStatus")), F.lit(""))
    first = at(data, "$.result.alternatives[0].message.text")
    said = F.when(first.isNotNull(), string_at(data, "$.result.alternatives[0].message.text")).otherwise(string_at(data, "$.completions[0].text"))
    is_code = lambda n: F.coalesce(code == n, F.lit(False))
    ladder = lambda content: [
        _malformed(data, body),
        (problem.isNotNull() & is_code(400) & F.contains(F.lower(message), F.lit("folder id")), "wrong_folder", message),
        (problem.isNotNull() & (is_code(401) | F.contains(status, F.lit("unauthorized"))), "unauthorized", message),
        (problem.isNotNull() & is_code(500), "server_error", message),
        (problem.isNotNull(), "api_error", F.concat(F.coalesce(F.concat(F.lit("HTTP "), said_at(data, "$.error.httpCode"), F.lit(": ")), F.lit("")), message)),
        (content.isNull(), "empty", F.concat(F.lit("no translation: "), body)),
    ]
    return _result(said, at(data, "$.result.usage"), ladder)


@_of_decoded
def deepl(data: Column, body: Column, settings: dict) -> Column:
    """Tags become JSON punctuation again, whatever the format; there is no usage."""
    said = said_at(data, "$.translations[0].text")
    ladder = lambda content: [(content.isNull(), "empty", F.concat(F.lit("no translation: "), body))]
    return _result(tx.untag_json(said), F.lit(None).cast("variant"), ladder, marked=False)


PARSERS: dict[str, Callable[[Column, dict], Column]] = {"anthropic": anthropic, "deepl": deepl, "google": google, "openai": openai, "yandex": yandex, "xai": xai}


def parse(body: Column, settings: dict) -> Column:
    vendor = settings.get("vendor")
    if vendor not in PARSERS:
        raise KeyError(f"no parser of responses for vendor {vendor}")
    return PARSERS[vendor](body, settings)


def http_error(status: Column, body: Column, settings: dict) -> Column:
    """struct(code, message) for a status of 400 or more, unless the service's own errors say more."""
    failed = (status >= 400) & F.lit(not settings.get("http_error_handling"))
    return F.when(failed, F.struct(F.lit("http_error").alias("code"), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.coalesce(body, F.lit(""))).alias("message")))


def preview(response: Column, secrets: list[str]) -> Column:
    """What a log says of a response: status, each value of each header, body, without secrets."""
    lines = F.transform(F.map_entries(response["headers"]), lambda h: F.array_join(F.transform(h["value"], lambda v: F.concat(F.lit("  "), h["key"], F.lit(": "), tx.masked(v, secrets), F.lit("\n"))), ""))
    return F.concat(F.lit("response "), response["status"].cast("string"), F.lit("\nHeaders:\n"), F.coalesce(F.array_join(lines, ""), F.lit("")), F.lit("\nBody:\n"), F.coalesce(tx.masked(response["body"], secrets), F.lit("")), F.lit("\n"))
