"""Reads of a VARIANT by path, with the coercions of the event format: a missing path is not a JSON null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def has(v: Column, path: str) -> Column:
    """The path is there, be it a JSON null."""
    return node(v, path).isNotNull()


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(node(v, path))


def is_text(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path) == "STRING", F.lit(False))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path).startswith("ARRAY"), F.lit(False))


def shown(s: Column, v: Column, path: str) -> Column:
    """text(v, path), but null where the path is missing; s: what a cast to string gives there, null of a missing path and of a JSON null alone."""
    nested = F.left(s, F.lit(1)).isin("{", "[") & kind_of(v, path).rlike("^(OBJECT|ARRAY)")
    return F.coalesce(F.when(nested, "").otherwise(s), F.when(F.is_variant_null(node(v, path)), "null"))


def text(v: Column, path: str) -> Column:
    """Scalars as text; missing, object and array: empty; JSON null: the word null."""
    return F.coalesce(shown(F.try_variant_get(v, path, "string"), v, path), F.lit(""))


def number(v: Column, path: str) -> Column:
    """Whole numbers, also from text; anything else: 0."""
    return F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0).cast("long"))


def flag(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def parse(raw: str | Column) -> Column:
    return F.try_parse_json(F.col(raw) if isinstance(raw, str) else raw)
