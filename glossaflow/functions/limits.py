"""How much text a model takes, and whether a prepared text fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token, the share of tokens kept for the answer where its limit is unknown, and the characters kept for the prompt.
CHARS_PER_TOKEN, RESERVE_SHARE, PROMPT_CHARS = 4, 0.2, 2000


def gross_limit(estimated_chars: Column, max_tokens: Column, max_output_tokens: Column) -> Column:
    """Characters that fit, before the prompt. With a token limit: its tokens without those of the answer, at most the estimate if there is one."""
    estimated, tokens, out = (F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint")) for x in (estimated_chars, max_tokens, max_output_tokens))
    reserve = F.when(out > 0, out).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(tokens * F.lit(RESERVE_SHARE))))
    by_tokens = F.greatest(F.lit(0).cast("bigint"), tokens - reserve) * CHARS_PER_TOKEN
    return F.when(tokens > 0, F.when(estimated > 0, F.least(estimated, by_tokens)).otherwise(by_tokens)).otherwise(estimated)


def net_limit(gross: Column) -> Column:
    """What is left for the text; 0 means that nothing is checked."""
    return F.greatest(F.lit(0).cast("bigint"), gross - PROMPT_CHARS)


def of_settings(settings: dict) -> Column:
    """The net limit of one model's settings, a literal of a plan once it is optimized."""
    held = settings.get("limits") or {}
    return net_limit(gross_limit(*[F.lit(held.get(k)).cast("bigint") for k in ("estimated_max_chars", "max_tokens", "max_output_tokens")]))


def fits(prepared: Column, limit: Column) -> Column:
    return (limit == 0) | (F.length(prepared) <= limit)


def excess(prepared: Column, limit: Column) -> Column:
    """By how many characters a text is too long."""
    return F.when(fits(prepared, limit), F.lit(0).cast("bigint")).otherwise(F.length(prepared) - limit)
