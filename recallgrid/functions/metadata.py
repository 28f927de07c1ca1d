"""Free-form metadata: typed values to strings and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_value(value: Column, kind: T.DataType) -> Column:
    """Lists, maps and structs as JSON, everything else as its string."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def encode_metadata(metadata: Column, schema: T.StructType) -> Column:
    """A metadata struct as a map of strings; missing fields are left out."""
    entries = [
        F.struct(
            F.lit(f.name).alias("key"),
            encode_value(metadata[f.name], f.dataType).alias("value"),
        )
        for f in schema.fields
    ]
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return F.map_from_entries(present)


def decode_value(value: Column) -> Column:
    """A VARIANT: the value the text spells, or the text itself.

    Numbers, lists and objects come back typed; ``hello`` stays a string.
    """
    # A text that is no JSON is quoted, which makes it a JSON string.
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.coalesce(
        F.try_parse_json(value), F.variant_get(F.parse_json(quoted), "$.v", "variant")
    )


def decode_metadata(metadata: Column) -> Column:
    """A map of strings to a map of VARIANT values."""
    return F.transform_values(metadata, lambda _, v: decode_value(v))
