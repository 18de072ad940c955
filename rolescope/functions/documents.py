"""Paths into profile documents of varying shape, as variants: no schema is imposed and nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document(c: Column) -> Column:
    """Variant of a JSON text; a string that holds a document is opened; null for null and malformed texts."""
    outer = F.try_parse_json(c)
    return F.coalesce(F.try_parse_json(F.try_variant_get(outer, "$", "string")), outer)


def entries(doc: Column, path: str) -> Column:
    """Elements below a path as an array of variants: a lone value is an array of one, null and absence an empty one.

    Null elements keep their place.
    """
    listed = F.try_variant_get(doc, path, "array<variant>")
    lone = F.try_variant_get(doc, path, "variant")
    none = F.expr("cast(array() as array<variant>)")
    return F.when(listed.isNotNull(), listed).when(lone.isNull() | F.is_variant_null(lone), none).otherwise(F.array(lone))


def text_at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def entry_texts(doc: Column, path: str, field: str) -> Column:
    """A member of each entry, entries without it left out."""
    values = F.transform(entries(doc, path), lambda e: F.try_variant_get(e, f"$.{field}", "string"))
    return F.filter(values, lambda t: t.isNotNull() & (t != ""))
