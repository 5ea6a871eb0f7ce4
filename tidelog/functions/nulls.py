"""Lenient casts, null markers and fallbacks."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The three dictionaries of null markers. They differ on purpose and are kept apart.
CSV_NULLS = ("", "nan", "None")
TOKEN_NULLS = ("N/A", "NONE", "NULL", "UNKNOWN")
PLACEHOLDER = "^_*$"


def strip(text: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def lenient(value: Column, kind: str) -> Column:
    """Cast, null where it can't be; whole numbers may be written with a fraction (``12.0``)."""
    if kind in ("bigint", "int"):
        number = value.cast("string").try_cast("double")
        return F.when(number == F.floor(number), number.cast(kind))
    if kind == "double":
        return nan_to_null(value.cast("string").try_cast("double"))
    return value.cast("string").try_cast(kind)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def marker_to_null(text: Column, markers: Sequence[str] = CSV_NULLS) -> Column:
    return F.when(~text.isin(*markers), text)


def placeholder_to_null(text: Column) -> Column:
    """Stripped text; null if nothing or only underscores are left."""
    clean = strip(text)
    return F.when(~clean.rlike(PLACEHOLDER), clean)


def without_placeholders(value: Column, kind: T.DataType) -> Column:
    """A nested column in which every text that is blank or holds only underscores is null, at any depth: fields, items and map values alike; keys and other texts stay as they are.

    Columns with a schema are walked by their schema, without leaving the JVM; a variant by its values.
    """
    if isinstance(kind, T.StringType):
        return F.when(~strip(value).rlike(PLACEHOLDER), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_placeholders(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: without_placeholders(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[without_placeholders(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.VariantType):
        cleaned = F.pandas_udf(_cleaned, T.StringType())
        return F.parse_json(cleaned(F.to_json(value)))
    return value


def _walked(value: object) -> object:
    if isinstance(value, str):
        return None if not value.strip().strip("_") else value
    if isinstance(value, list):
        return [_walked(x) for x in value]
    return {k: _walked(x) for k, x in value.items()} if isinstance(value, dict) else value


def _cleaned(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: None if d is None else json.dumps(_walked(json.loads(d)), ensure_ascii=False))


def valid_text(text: Column, least: int = 5) -> Column:
    """More than ``least`` characters and no null token."""
    clean = strip(text)
    return F.coalesce((F.length(clean) > least) & ~F.upper(clean).isin(*TOKEN_NULLS), F.lit(False))
