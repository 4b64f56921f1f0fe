"""What a language model replied, decoded from JSON as variants: malformed replies, missing keys and values of another type get a default.

A reply may stand in a fenced block. Nothing here raises: a reply is data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import once

_FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def parsed(reply: Column) -> Column:
    """The reply as a variant; null where it is no JSON."""
    return F.try_parse_json(F.regexp_replace(reply, _FENCE, "$1"))


def _strings(items: Column) -> Column:
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def decode_strings(reply: Column, key: str, default: Column) -> Column:
    """The strings of the list under ``key``, other elements left out; ``default`` where there is no such list or no string in it."""
    items = F.try_variant_get(parsed(reply), f"$.{key}", "array<variant>")
    return once(_strings(items), lambda s: F.when(F.size(s) > 0, s).otherwise(default))


def decode_triples(reply: Column, key: str) -> Column:
    """The lists of exactly three strings in the list under ``key``, lower-cased; none where there is no such list."""
    items = F.try_variant_get(parsed(reply), f"$.{key}", "array<variant>")
    lists = F.transform(items, lambda x: F.try_variant_get(x, "$", "array<variant>"))
    good = F.filter(lists, lambda t: (F.size(t) == 3) & F.forall(t, lambda x: F.schema_of_variant(x) == "STRING"))
    return F.coalesce(F.transform(good, lambda t: F.transform(_strings(t), F.lower)), F.array().cast("array<array<string>>"))


def decode_score(reply: Column, key: str, default: float) -> Column:
    """The number under ``key``, from 0 to 1; ``default`` where there is none, or one out of these bounds."""
    v = F.try_variant_get(parsed(reply), f"$.{key}", "variant")
    number = F.when(F.schema_of_variant(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))
    return once(number, lambda x: F.when((x >= 0) & (x <= 1), x).otherwise(F.lit(default)))


def decode_label(reply: Column, key: str, labels: tuple[str, ...], default: str) -> Column:
    """The label under ``key``, trimmed and lower-cased; ``default`` where it is none of ``labels``."""
    found = F.lower(F.trim(F.try_variant_get(parsed(reply), f"$.{key}", "string")))
    return F.when(found.isin(*labels), found).otherwise(F.lit(default))
