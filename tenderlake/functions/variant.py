"""Fields of JSON documents that are a scalar in one row and a list in another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields_of(doc: Column, names: list[str]) -> Column:
    """A struct of those fields as they are, cut out in one pass over the document; null where it is no object."""
    return F.try_variant_get(doc, "$", f"struct<{', '.join(f'`{n}`: variant' for n in names)}>")


def first_or(doc: Column, name: str, kind: str, default=None) -> Column:
    """A list's first element (null if that is null); the default for an empty list, null or a missing field; else the scalar."""
    return _first_or(doc, f"$.{name}", kind, default)


def value_or(field: Column, kind: str, default=None) -> Column:
    """first_or of a field that was cut out of its document."""
    return _first_or(field, "$", kind, default)


def _first_or(doc: Column, path: str, kind: str, default) -> Column:
    items = F.try_variant_get(doc, path, "array<variant>")
    fallback = F.lit(default).cast(kind)
    return F.when(F.size(items) > 0, F.try_variant_get(doc, f"{path}[0]", kind)).when(items.isNotNull(), fallback).otherwise(F.coalesce(F.try_variant_get(doc, path, kind), fallback))
