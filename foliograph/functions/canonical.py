"""Canonical forms: rounding, number text, JSON, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a ratio before it is compared with its minimum (fixed value: the spacing of doubles at 1).
EPSILON = 2.0**-52
#: White space that trimming takes away (fixed value).
SPACE = r"\s\x0b\x85   -     　﻿"


def round_half_up(x: Column, digits: int) -> Column:
    """Rounds halves toward plus infinity; numbers too large to have such digits stay; no minus zero."""
    scaled = x * F.lit(float(10**digits))
    rounded = F.floor(scaled + 0.5).cast("double") / F.lit(float(10**digits))
    return F.when(F.abs(scaled) < float(2**52), rounded).otherwise(x) + F.lit(0.0)


def at_least(x: Column, minimum: Column | float) -> Column:
    return x + F.lit(EPSILON) >= minimum


def below(x: Column, minimum: Column | float) -> Column:
    return x + F.lit(EPSILON) < minimum


def number_text(x: Column) -> Column:
    """Shortest text of a double; integers without a point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def text_order(x: Column) -> Column:
    """A key by which text sorts as its UTF-16 code units do: astral characters come before those from U+E000 on."""
    return F.encode(x, "UTF-16BE")


def sorted_text(x: Column) -> Column:
    """An array of text in the order of its UTF-16 code units."""
    return F.transform(F.array_sort(F.transform(x, lambda v: F.struct(text_order(v).alias("k"), v.alias("v")))), lambda v: v["v"])


def canonical_json(*columns: Column) -> Column:
    """JSON of the aliased columns in the given order; nulls stay."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def fingerprint(rule_id: Column, input_key: Column, part: Column, slide_id: Column, slide_number: Column, shape_ids: Column, discriminator: Column) -> Column:
    """SHA-256 of the identity of a finding; nothing that a message or severity says is in it."""
    return F.sha2(
        canonical_json(
            F.lit(1).alias("schemaVersion"), rule_id.alias("ruleId"), input_key.alias("inputKey"), part.alias("part"),
            slide_id.alias("slideId"), slide_number.alias("slideNumber"), shape_ids.alias("shapeIds"), discriminator.alias("discriminator"),
        ),
        256,
    )


def json_text(x: Column) -> Column:
    """A string as JSON; null as null."""
    quoted = F.to_json(F.array(x))
    return F.when(x.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def json_number(x: Column) -> Column:
    return F.coalesce(number_text(x.cast("double")), F.lit("null"))


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**values: Column) -> Column:
    """An object of JSON texts, its keys in order."""
    pairs = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
