"""Requests to the services, as struct(url, headers, body) columns.

What is common to a job (model, prompt, options) is known when the plan is
built, so it becomes literals; only texts are columns. No key is ever in a
column: the transport adds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from .prompts import Prompts


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _json(body: Column) -> Column:
    """Members that are null are left out."""
    return F.to_json(body)


def _option(settings: dict, options: dict, name: str, default_name: str | None = None, otherwise=None):
    for held, n in ((options, name), (settings.get("defaults") or {}, default_name or name)):
        if held.get(n) is not None:
            return held[n]
    return otherwise


def _need(value, what: str):
    if value is None:
        raise ValueError(f"{what} is missing")
    return value


def prompt(settings: dict, options: dict, prompts: Prompts, with_format: bool = True) -> Column:
    """The system prompt of a job. The context may be a column."""
    defaults = settings.get("defaults") or {}
    context = options.get("context") if options.get("context") is not None else defaults.get("context")
    said = tx.trimmed(_lit(context if context is not None else ""))
    values = {
        "source": F.lit(defaults.get("source_lang") or "auto"),
        "target": F.lit(defaults.get("target_lang") or "EN"),
        "start": F.lit(tx.START),
        "end": F.lit(tx.END),
        "context": F.when(said != "", F.concat(F.lit("Context: "), said)).otherwise(F.lit("")),
    }
    format_name = options.get("format") or defaults.get("format") or (settings.get("format") if with_format else None) or "text"
    return prompts.render(options.get("promptKey") or "translator", format_name, values)


def _messages(system: Column, text: Column, name: str) -> Column:
    turn = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias(name))
    return F.array(turn("system", system), turn("user", tx.wrap(text)))


def _temperature(settings: dict, options: dict) -> Column:
    return F.lit(float(_option(settings, options, "temperature", otherwise=0.0)))


def anthropic(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    model = _need((settings.get("defaults") or {}).get("model"), "the model's name")
    most = _option(settings, options, "maxTokens", "max_tokens", 1000)
    return _json(F.struct(F.lit(model).alias("model"), _messages(prompt(settings, options, prompts), text, "content").alias("messages"), F.lit(int(most)).alias("max_tokens"), _temperature(settings, options).alias("temperature")))


def openai(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    model = _need((settings.get("defaults") or {}).get("model"), "the model's name")
    return _json(F.struct(F.lit(model).alias("model"), _messages(prompt(settings, options, prompts), text, "content").alias("messages"), _temperature(settings, options).alias("temperature")))


def xai(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    model = _need((settings.get("defaults") or {}).get("model"), "the model's name")
    return _json(F.struct(F.lit(model).alias("model"), _messages(prompt(settings, options, prompts), text, "content").alias("messages"), _temperature(settings, options).alias("temperature"), F.lit(False).alias("stream")))


def google(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    part = lambda said: F.struct(F.array(F.struct(said.alias("text"))).alias("parts"))
    most = _option(settings, options, "maxOutputTokens")
    members = [_temperature(settings, options).alias("temperature"), F.lit(int(_option(settings, options, "candidateCount", otherwise=1))).alias("candidateCount")]
    if most is not None:
        members.append(F.lit(int(most)).alias("maxOutputTokens"))
    # only options ask for thoughts, defaults of the registry don't
    thinking = [F.lit(int(options["thinkingBudget"])).alias("thinkingBudget")] if options.get("thinkingBudget") is not None else []
    thinking += [F.lit(options["includeThoughts"]).alias("includeThoughts")] if options.get("includeThoughts") is not None else []
    if thinking:
        members.append(F.struct(*thinking).alias("thinkingConfig"))
    return _json(F.struct(part(prompt(settings, options, prompts, False)).alias("system_instruction"), F.array(part(tx.wrap(text))).alias("contents"), F.struct(*members).alias("generationConfig")))


def yandex(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    folder = _need(options.get("folder_id"), "folder_id")
    model = _need((settings.get("defaults") or {}).get("model"), "the model's name")
    completion = F.struct(F.lit(False).alias("stream"), _temperature(settings, options).alias("temperature"), F.lit(int(_option(settings, options, "maxTokens", "max_tokens", 0))).alias("maxTokens"))
    return _json(F.struct(F.concat(F.lit("gpt://"), _lit(folder), F.lit(f"/{model}")).alias("modelUri"), completion.alias("completionOptions"), _messages(prompt(settings, options, prompts), text, "text").alias("messages")))


def deepl(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    defaults = settings.get("defaults") or {}
    format_name = options.get("format") or defaults.get("format") or "text"
    fields = [("text", tx.tag_json(text) if format_name == "json" else text), ("target_lang", F.lit(defaults.get("target_lang") or "EN")), ("formality", F.lit(defaults.get("formality") or "prefer_more"))]
    fields += [(k, _lit(defaults[k])) for k in ("source_lang", "context") if defaults.get(k)]
    if format_name in ("html", "json"):
        fields += [("tag_handling", F.lit("html")), ("preserve_formatting", F.lit("1")), ("outline_detection", F.lit("1"))]
    return tx.form_body(fields)


Builder = Callable[[dict, Column, dict, Prompts], Column]
#: Add a vendor's builder here and its parser in responses.PARSERS.
BUILDERS: dict[str, Builder] = {"anthropic": anthropic, "deepl": deepl, "google": google, "openai": openai, "yandex": yandex, "xai": xai}


def builder(vendor: str | None) -> Builder:
    if vendor not in BUILDERS:
        raise KeyError(f"no builder of requests for vendor {vendor}")
    return BUILDERS[vendor]


def build(settings: dict, text: Column, options: dict, prompts: Prompts) -> Column:
    """struct(url, headers, body) of one model's request."""
    headers = (settings.get("requirements") or {}).get("headers") or []
    body = builder(settings.get("vendor"))(settings, text, options, prompts)
    return F.struct(F.lit(settings.get("endpoint")).alias("url"), F.array(*map(F.lit, headers)).cast("array<string>").alias("headers"), body.alias("body"))


def preview(request: Column, secrets: list[str], method: str = "POST", sent: bool = False) -> Column:
    """What a log says of a request: title, method and address, headers, body, without secrets."""
    headers = F.array_join(F.transform(request["headers"], lambda h: F.concat(F.lit("  "), tx.masked(h, secrets), F.lit("\n"))), "")
    body = tx.masked(request["body"], secrets)
    return F.concat(F.lit("request sent\n" if sent else "request not sent\n"), F.lit(method + " "), request["url"], F.lit("\n\nHeaders:\n"), headers, F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("\nBody:\n"), body, F.lit("\n"))).otherwise(F.lit("")))
