"""What the registry of models must hold, stated once more for the SQL of its queries."""

from __future__ import annotations

#: Fixed values of the built-in registry: key, vendor, address, format, key's variable, help address, name at the service, estimated characters, tokens, tokens of an answer, target and source language.
MODELS: list[tuple] = [
    ("anthropic:claude-haiku-3.5", "anthropic", "https://api.anthropic.com/v1/chat/completions", "text", "ANTHROPIC_API_KEY", "https://console.anthropic.com/", "claude-3-5-haiku-latest", 400000, None, None, "EN", "auto"),
    ("anthropic:claude-opus-4", "anthropic", "https://api.anthropic.com/v1/chat/completions", "text", "ANTHROPIC_API_KEY", "https://console.anthropic.com/", "claude-opus-4-20250514", 800000, None, None, "EN", "auto"),
    ("anthropic:claude-sonnet-4", "anthropic", "https://api.anthropic.com/v1/chat/completions", "text", "ANTHROPIC_API_KEY", "https://console.anthropic.com/", "claude-sonnet-4-20250514", 800000, None, None, "EN", "auto"),
    ("deepl:free", "deepl", "https://api-free.deepl.com/v2/translate", "text|html", "DEEPL_FREE_API_KEY", "https://www.deepl.com/account/summary", None, 30000, None, None, "EN", None),
    ("deepl:pro", "deepl", "https://api.deepl.com/v2/translate", "text|html", "DEEPL_PRO_API_KEY", "https://www.deepl.com/account/summary", None, 30000, None, None, "EN", None),
    ("google:gemini-2.5-flash", "google", "https://generativelanguage.googleapis.com/v1beta/models/gemini-2.5-flash:generateContent", "text", "GOOGLE_API_KEY", "https://makersuite.google.com/app/apikey", "gemini-2.5-flash", 524288, 131072, None, None, None),
    ("google:gemini-2.5-flash-lite", "google", "https://generativelanguage.googleapis.com/v1beta/models/gemini-2.5-flash-lite:generateContent", "text", "GOOGLE_API_KEY", "https://makersuite.google.com/app/apikey", "gemini-2.5-flash-lite", 524288, 131072, None, None, None),
    ("google:gemini-2.5-pro", "google", "https://generativelanguage.googleapis.com/v1beta/models/gemini-2.5-pro:generateContent", "text", "GOOGLE_API_KEY", "https://makersuite.google.com/app/apikey", "gemini-2.5-pro", 1048576, 262144, None, None, None),
    ("google:gemini-2.0-flash", "google", "https://generativelanguage.googleapis.com/v1beta/models/gemini-2.0-flash:generateContent", "text", "GOOGLE_API_KEY", "https://makersuite.google.com/app/apikey", "gemini-2.0-flash", 524288, 131072, None, None, None),
    ("openai:gpt-5", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-5", 1600000, 400000, 128000, None, None),
    ("openai:gpt-5-mini", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-5-mini", 1600000, 400000, 128000, None, None),
    ("openai:gpt-5-nano", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-5-nano", 1600000, 400000, 128000, None, None),
    ("openai:gpt-4o", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-4o", 512000, 128000, 16384, None, None),
    ("openai:gpt-4o-mini", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-4o-mini", 512000, 128000, 16384, None, None),
    ("openai:gpt-4", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-4", 32768, 8192, None, None, None),
    ("openai:gpt-4-turbo", "openai", "https://api.openai.com/v1/chat/completions", None, "OPENAI_API_KEY", "https://platform.openai.com/account/api-keys", "gpt-4-turbo", 512000, 128000, None, None, None),
    ("yandex:gpt-lite", "yandex", "https://llm.api.cloud.yandex.net/foundationModels/v1/completion", "text", "YANDEX_API_KEY", "https://yandex.cloud/en/docs/foundation-models/api-ref/authentication", "yandexgpt-lite/latest", 32768, 8192, None, None, None),
    ("yandex:gpt-pro", "yandex", "https://llm.api.cloud.yandex.net/foundationModels/v1/completion", "text", "YANDEX_API_KEY", "https://yandex.cloud/en/docs/foundation-models/api-ref/authentication", "yandexgpt/latest", 32768, 8192, None, None, None),
    ("yandex:gpt-32k", "yandex", "https://llm.api.cloud.yandex.net/foundationModels/v1/completion", "text", "YANDEX_API_KEY", "https://yandex.cloud/en/docs/foundation-models/api-ref/authentication", "yandexgpt-32k/latest", 128000, 32000, None, None, None),
    ("yandex:llama-lite", "yandex", "https://llm.api.cloud.yandex.net/foundationModels/v1/completion", "text", "YANDEX_API_KEY", "https://yandex.cloud/en/docs/foundation-models/api-ref/authentication", "llama-lite/latest", 32768, 8192, None, None, None),
    ("yandex:llama", "yandex", "https://llm.api.cloud.yandex.net/foundationModels/v1/completion", "text", "YANDEX_API_KEY", "https://yandex.cloud/en/docs/foundation-models/api-ref/authentication", "llama/latest", 32768, 8192, None, None, None),
    ("xai:grok-4", "xai", "https://api.x.ai/v1/chat/completions", "text", "XAI_API_KEY", "https://console.x.ai/team/default/api-keys", "grok-4", 1024000, 256000, None, "EN", "auto"),
    ("xai:grok-3", "xai", "https://api.x.ai/v1/chat/completions", "text", "XAI_API_KEY", "https://console.x.ai/team/default/api-keys", "grok-3", 524288, 131072, None, "EN", "auto"),
    ("xai:grok-3-mini", "xai", "https://api.x.ai/v1/chat/completions", "text", "XAI_API_KEY", "https://console.x.ai/team/default/api-keys", "grok-3-mini", 524288, 131072, None, "EN", "auto"),
]
