"""Expressions on names and rendered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subsample_size(trail: str | Column) -> Column:
    """The number in ``_sub<n>_`` of a trail name; null without one."""
    return F.regexp_extract(trail, r"_sub(\d+)_", 1).try_cast("int")


def trailing_number(text: str | Column) -> Column:
    """Digits at the end; the empty string without any."""
    return F.regexp_extract(text, r"(\d+)$", 1)


def parsed_list(text: str | Column) -> Column:
    """A rendered list of numbers as an array; anything else gives an empty array."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def stem_parts(stem: str | Column) -> Column:
    """Data set and origin of a file stem, split at its last underscore."""
    c = F.col(stem) if isinstance(stem, str) else stem
    return F.struct(F.regexp_extract(c, r"^(.*)_[^_]*$", 1).alias("dataset"), F.element_at(F.split(c, "_"), -1).alias("origin"))


def short_label(text: str | Column, drop: list[str]) -> Column:
    """``GEN<n>`` for names with a genetic sample number, else the last two underscore parts, ``drop`` left out."""
    c = F.col(text) if isinstance(text, str) else text
    number = F.regexp_extract(c, r"gen(?:etik_probe_)?(\d+)", 1)
    parts = F.filter(F.split(c, "_"), lambda x: ~x.isin(*drop)) if drop else F.split(c, "_")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(number != "", F.concat(F.lit("GEN"), number)).otherwise(F.array_join(tail, "_"))


def truth_flag(c: str | Column) -> Column:
    """1 for true, 1, yes and same in any case, null for null, else 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "same").cast("int"))


def standard_sex(c: str | Column) -> Column:
    """Female for f, female and 0; Male for m, male and 1; else Unknown, null included."""
    c = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.when(c.isin("f", "female", "0"), "Female").when(c.isin("m", "male", "1"), "Male").otherwise("Unknown")
