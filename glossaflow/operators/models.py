"""The registry of models: nested settings by vendor, flattened to one entry a model, as a small dimension table.

Settings are nested and dynamic, so they stay a dictionary on the driver; the
table has the typed part that plans join with. It has as many rows as there
are models, so joins broadcast it.
"""

from __future__ import annotations

import os
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession

_JSON, _BEARER = "Content-Type: application/json", {"type": "header", "key_name": "Authorization", "prefix": "Bearer"}


def _chat_usage(**more: str) -> dict:
    return {"tokens": {"total": "total_tokens", "breakdown": {"prompt": "prompt_tokens", "completion": "completion_tokens", **more}}}


# Public addresses, names, limits and authentication of the services.
_VENDORS: dict[str, dict] = {
    "anthropic": {
        "endpoint": "https://api.anthropic.com/v1/chat/completions",
        "format": "text",
        "defaults": {"temperature": 0.0, "source_lang": "auto", "target_lang": "EN"},
        "requirements": {"auth": {"type": "header", "key_name": "x-api-key", "env": "ANTHROPIC_API_KEY", "help_url": "https://console.anthropic.com/"}, "headers": [_JSON, "Anthropic-Version: 2023-06-01"]},
        "limits": {"estimated_max_chars": 400000},
        "http_error_handling": True,
        "usage": _chat_usage(),
    },
    "deepl": {
        "endpoint": "https://api-free.deepl.com/v2/translate",
        "format": "text|html",
        "defaults": {"target_lang": "EN", "formality": "prefer_more"},
        "requirements": {"auth": {"type": "form", "key_name": "auth_key", "help_url": "https://www.deepl.com/account/summary"}, "headers": ["Content-Type: application/x-www-form-urlencoded"]},
        "limits": {"estimated_max_chars": 30000},
    },
    "google": {
        "format": "text",
        "defaults": {"temperature": 0.0, "candidateCount": 1, "maxOutputTokens": None},
        "requirements": {"auth": {"type": "header", "key_name": "x-goog-api-key", "env": "GOOGLE_API_KEY", "help_url": "https://makersuite.google.com/app/apikey"}, "headers": [_JSON]},
        "usage": {"tokens": {"total": "totalTokenCount", "breakdown": {"prompt": "promptTokenCount", "candidates": "candidatesTokenCount", "thoughts": "thoughtsTokenCount"}}},
    },
    "openai": {
        "endpoint": "https://api.openai.com/v1/chat/completions",
        "defaults": {"temperature": 0.0},
        "requirements": {"auth": {**_BEARER, "env": "OPENAI_API_KEY", "help_url": "https://platform.openai.com/account/api-keys"}, "headers": [_JSON]},
        "usage": _chat_usage(reasoning="completion_tokens_details.reasoning_tokens"),
    },
    "yandex": {
        "endpoint": "https://llm.api.cloud.yandex.net/foundationModels/v1/completion",
        "format": "text",
        "defaults": {"temperature": 0.0, "max_tokens": 8192},
        "requirements": {"auth": {**_BEARER, "env": "YANDEX_API_KEY", "help_url": "https://yandex.cloud/en/docs/foundation-models/api-ref/authentication"}, "variables": {"folder_id": "YANDEX_FOLDER_ID"}, "headers": [_JSON]},
        "limits": {"max_tokens": 8192, "estimated_max_chars": 32768},
        "http_error_handling": True,
        "usage": {"tokens": {"total": "totalTokens", "breakdown": {"input": "inputTextTokens", "completion": "completionTokens"}}},
    },
    "xai": {
        "endpoint": "https://api.x.ai/v1/chat/completions",
        "format": "text",
        "defaults": {"temperature": 0.0, "source_lang": "auto", "target_lang": "EN"},
        "requirements": {"auth": {**_BEARER, "env": "XAI_API_KEY", "help_url": "https://console.x.ai/team/default/api-keys"}, "headers": [_JSON]},
        "usage": _chat_usage(reasoning="completion_tokens_details.reasoning_tokens"),
    },
}

# Vendor, model, its name at the service, estimated characters, tokens, tokens of an answer, and what differs from the vendor.
_MODELS: list[tuple] = [
    ("anthropic", "claude-haiku-3.5", "claude-3-5-haiku-latest", 400000, None, None, {"max_tokens": 8192}),
    ("anthropic", "claude-opus-4", "claude-opus-4-20250514", 800000, None, None, {"max_tokens": 32000}),
    ("anthropic", "claude-sonnet-4", "claude-sonnet-4-20250514", 800000, None, None, {"max_tokens": 64000}),
    ("deepl", "free", None, 30000, None, None, {}),
    ("deepl", "pro", None, 30000, None, None, {}),
    ("google", "gemini-2.5-flash", "gemini-2.5-flash", 524288, 131072, None, {}),
    ("google", "gemini-2.5-flash-lite", "gemini-2.5-flash-lite", 524288, 131072, None, {}),
    ("google", "gemini-2.5-pro", "gemini-2.5-pro", 1048576, 262144, None, {}),
    ("google", "gemini-2.0-flash", "gemini-2.0-flash", 524288, 131072, None, {}),
    ("openai", "gpt-5", "gpt-5", 1600000, 400000, 128000, {"temperature": 1}),
    ("openai", "gpt-5-mini", "gpt-5-mini", 1600000, 400000, 128000, {"temperature": 1}),
    ("openai", "gpt-5-nano", "gpt-5-nano", 1600000, 400000, 128000, {"temperature": 1}),
    ("openai", "gpt-4o", "gpt-4o", 512000, 128000, 16384, {}),
    ("openai", "gpt-4o-mini", "gpt-4o-mini", 512000, 128000, 16384, {}),
    ("openai", "gpt-4", "gpt-4", 32768, 8192, None, {}),
    ("openai", "gpt-4-turbo", "gpt-4-turbo", 512000, 128000, None, {}),
    ("yandex", "gpt-lite", "yandexgpt-lite/latest", 32768, 8192, None, {}),
    ("yandex", "gpt-pro", "yandexgpt/latest", 32768, 8192, None, {}),
    ("yandex", "gpt-32k", "yandexgpt-32k/latest", 128000, 32000, None, {"max_tokens": 32000}),
    ("yandex", "llama-lite", "llama-lite/latest", 32768, 8192, None, {}),
    ("yandex", "llama", "llama/latest", 32768, 8192, None, {}),
    ("xai", "grok-4", "grok-4", 1024000, 256000, None, {}),
    ("xai", "grok-3", "grok-3", 524288, 131072, None, {}),
    ("xai", "grok-3-mini", "grok-3-mini", 524288, 131072, None, {}),
]
#: What the list of models says about each, in own words: name and notes.
_ABOUT: dict[str, tuple[str, str]] = {
    "anthropic:claude-haiku-3.5": ("Claude 3.5 Haiku", "Small and quick; for short, simple texts in bulk."),
    "anthropic:claude-opus-4": ("Claude Opus 4", "Largest of its family; for hard texts where cost matters less."),
    "anthropic:claude-sonnet-4": ("Claude Sonnet 4", "Between the two: long answers at moderate cost."),
    "deepl:free": ("DeepL API Free", "Machine translation with a monthly quota; text, HTML and JSON as tags."),
    "deepl:pro": ("DeepL API Pro", "The same service by subscription, at its own address."),
    "google:gemini-2.5-flash": ("Gemini 2.5 Flash", "Quick, with optional thinking that counts as usage."),
    "google:gemini-2.5-flash-lite": ("Gemini 2.5 Flash-Lite", "Cheapest of its generation; for bulk."),
    "google:gemini-2.5-pro": ("Gemini 2.5 Pro", "Largest window of its family; thinks before it answers."),
    "google:gemini-2.0-flash": ("Gemini 2.0 Flash", "Of the generation before; without thinking."),
    "openai:gpt-5": ("GPT-5", "Reasons before it answers; takes the default temperature only."),
    "openai:gpt-5-mini": ("GPT-5 mini", "Smaller and cheaper than GPT-5; default temperature only."),
    "openai:gpt-5-nano": ("GPT-5 nano", "Smallest of its family, for bulk; default temperature only."),
    "openai:gpt-4o": ("GPT-4o", "All-round model without reasoning; answers of up to 16,384 tokens."),
    "openai:gpt-4o-mini": ("GPT-4o mini", "Cheap variant of GPT-4o with the same limits."),
    "openai:gpt-4": ("GPT-4", "Old model with a small window; kept for comparison."),
    "openai:gpt-4-turbo": ("GPT-4 Turbo", "GPT-4 with a window of 128,000 tokens."),
    "yandex:gpt-lite": ("YandexGPT Lite", "Quick; good at Russian. Needs a folder ID."),
    "yandex:gpt-pro": ("YandexGPT Pro", "Better at long sentences than Lite. Needs a folder ID."),
    "yandex:gpt-32k": ("YandexGPT 32k", "Pro with a window of 32,000 tokens. Needs a folder ID."),
    "yandex:llama-lite": ("Llama Lite (hosted)", "Small open model at the same address. Needs a folder ID."),
    "yandex:llama": ("Llama (hosted)", "Large open model at the same address. Needs a folder ID."),
    "xai:grok-4": ("Grok 4", "Reasons before it answers; large window."),
    "xai:grok-3": ("Grok 3", "General model of the generation before."),
    "xai:grok-3-mini": ("Grok 3 mini", "Small variant of Grok 3."),
}
_DEEPL = {"free": ("DEEPL_FREE_API_KEY", None), "pro": ("DEEPL_PRO_API_KEY", "https://api.deepl.com/v2/translate")}
_GEMINI = "https://generativelanguage.googleapis.com/v1beta/models/{}:generateContent"


def overlay(base: dict, over: dict) -> dict:
    """over on top of base, dictionaries member by member; a null of over wins too, lists go by place."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = overlay(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = v + out[k][len(v) :]
        else:
            out[k] = v
    return out


def builtin() -> dict[str, dict]:
    """The nested settings that come with the package, in the form that a registry file has."""
    nested = {vendor: {**deepcopy(held), "models": {}} for vendor, held in _VENDORS.items()}
    for vendor, model, name, chars, tokens, answer, defaults in _MODELS:
        own: dict = {"defaults": {**({"model": name} if name else {}), **defaults}, "limits": {k: v for k, v in (("estimated_max_chars", chars), ("max_tokens", tokens), ("max_output_tokens", answer)) if v}}
        if vendor == "google":
            own["endpoint"] = _GEMINI.format(model)
        if vendor == "deepl":
            env, endpoint = _DEEPL[model]
            own["requirements"] = {"auth": {"env": env}}
            own |= {"endpoint": endpoint} if endpoint else {}
        own["name"], own["notes"] = _ABOUT[f"{vendor}:{model}"]
        nested[vendor]["models"][model] = own
    return nested


def read_file(path: str) -> dict[str, dict]:
    """Nested settings from a YAML file."""
    import yaml

    if not os.access(path, os.R_OK):
        raise FileNotFoundError(f"no registry of models at {path}")
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def flatten(nested: dict[str, dict]) -> dict[str, dict]:
    """vendor:model to the vendor's settings with the model's on top; entries without models stay as they are."""
    out = {}
    for key, held in nested.items():
        if isinstance(held.get("models"), dict):
            shared = {k: v for k, v in held.items() if k != "models"}
            for model, own in held["models"].items():
                out[f"{key}:{model}"] = {**overlay(shared, own or {}), "vendor": key}
        else:
            out[key] = held
    return out


class Registry:
    """Flattened settings by model key, with accessors that give None (variables: nothing) where something is missing."""

    def __init__(self, path: str | None = None):
        self.models = flatten(read_file(path) if path else builtin())

    def keys(self) -> list[str]:
        return list(self.models)

    def has(self, key: str) -> bool:
        return key in self.models

    def get(self, key: str) -> dict | None:
        return self.models.get(key)

    def _at(self, key: str, *path: str):
        held = self.models.get(key)
        for p in path:
            held = held.get(p) if isinstance(held, dict) else None
        return held

    def endpoint(self, key: str) -> str | None:
        return self._at(key, "endpoint")

    def format(self, key: str) -> str | None:
        return self._at(key, "format")

    def most_chars(self, key: str) -> int | None:
        return self._at(key, "limits", "estimated_max_chars")

    def auth(self, key: str) -> dict | None:
        return self._at(key, "requirements", "auth")

    def auth_env(self, key: str) -> str | None:
        return self._at(key, "requirements", "auth", "env")

    def help_url(self, key: str) -> str | None:
        return self._at(key, "requirements", "auth", "help_url")

    def variables(self, key: str) -> dict[str, str]:
        return self._at(key, "requirements", "variables") or {}

    def notes(self, key: str) -> str | None:
        return self._at(key, "notes")

    def vendor(self, key: str) -> str | None:
        return self._at(key, "vendor")

    def by_vendor(self) -> dict[str, dict[str, dict]]:
        out: dict[str, dict[str, dict]] = {}
        for key, held in self.models.items():
            out.setdefault(held.get("vendor") or "other", {})[key] = held
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row a model; pos is the order of the registry."""
        rows = []
        for pos, (key, held) in enumerate(self.models.items()):
            needs, limits, auth = held.get("requirements") or {}, held.get("limits") or {}, (held.get("requirements") or {}).get("auth")
            rows.append(
                (
                    key,
                    held.get("vendor"),
                    pos,
                    held.get("name"),
                    held.get("endpoint"),
                    held.get("format"),
                    {k: None if v is None else str(v) for k, v in (held.get("defaults") or {}).items()},
                    auth and {k: auth.get(k) for k in ("type", "key_name", "prefix", "env", "help_url")},
                    needs.get("variables") or {},
                    needs.get("headers") or [],
                    {k: limits.get(k) for k in ("estimated_max_chars", "max_tokens", "max_output_tokens")},
                    bool(held.get("http_error_handling")),
                    held.get("notes"),
                )
            )
        return spark.createDataFrame(rows, MODEL_TYPE)


MODEL_TYPE = "model_key string, vendor string, pos int, name string, endpoint string, format string, defaults map<string,string>, auth struct<type: string, key_name: string, prefix: string, env: string, help_url: string>, variables map<string,string>, headers array<string>, limits struct<estimated_max_chars: bigint, max_tokens: bigint, max_output_tokens: bigint>, http_error_handling boolean, notes string"
