"""Lenient access to VARIANT records: a missing or odd field is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST = "array<variant>"


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def number(v: Column, path: str) -> Column:
    """A non-negative whole number."""
    n = F.try_variant_get(v, path, "bigint")
    return F.when(n >= 0, n)


def flag(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, LIST)


def present(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def is_object(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def plain_text(v: Column, path: str) -> Column:
    """The value when it is a JSON string (or another scalar), NULL for lists and objects."""
    return F.when(items(v, path).isNull() & ~is_object(v, path), text(v, path))


def json_of(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def timestamp(v: Column, path: str = "$.timestamp") -> Column:
    return F.try_to_timestamp(text(v, path))
