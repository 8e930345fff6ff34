"""Token usage in one form, whatever the service calls it.

A spec gives for each category a path of the total and paths of its parts; the
result is a map of category to total and parts. What is missing or no number
counts 0; numbers in strings count, with their fraction cut off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"
USAGE_TYPE = "map<string, struct<total: bigint, breakdown: map<string, bigint>>>"


def as_int(text: Column) -> Column:
    """The integer of a numeric text, 0 for others. Large integers keep all digits."""
    whole = F.when(text.rlike(r"^[ \t\n\r\x0B\f]*[+-]?[0-9]+[ \t\n\r\x0B\f]*$"), F.trim(text).try_cast("bigint"))
    real = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce(whole, real.try_cast("bigint"), F.lit(0).cast("bigint"))


def number_at(usage: Column, path: str) -> Column:
    """The integer at a dotted path of a VARIANT; objects only, as a path never enters lists."""
    return as_int(F.try_variant_get(usage, "$" + "".join(f'["{p}"]' for p in path.split(".")), "string"))


def consumed(usage: Column, spec: dict) -> Column:
    """usage: VARIANT. An empty map without a spec or usage."""
    empty = F.create_map().cast(USAGE_TYPE)
    if not spec:
        return empty
    entries = []
    for category, of in spec.items():
        parts = of.get("breakdown") or {}
        total = number_at(usage, of["total"]) if of.get("total") else F.lit(None).cast("bigint")
        made = F.create_map(*[x for name, path in parts.items() for x in (F.lit(name), number_at(usage, path))]) if parts else F.create_map().cast("map<string,bigint>")
        entries += [F.lit(category), F.struct(total.alias("total"), made.alias("breakdown"))]
    return F.when(usage.isNull(), empty).otherwise(F.create_map(*entries).cast(USAGE_TYPE))
