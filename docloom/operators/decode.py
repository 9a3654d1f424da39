"""Dynamic documents to typed structs, strictly by kind.

Text only from text, numbers only from numbers (whole ones are truncated), booleans from
booleans or from numbers above zero, bytes from base64 text; null and absent are NULL,
unknown keys are ignored. A value of another kind is an error.
"""

from __future__ import annotations

import base64
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.columns import Val

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class DecodeError(ValueError):
    pass


def _converted(value: Val, kind: T.DataType) -> tuple[Column, Column]:
    """(decoded column, whether the kind fits)."""
    nil = value.is_nil()
    if isinstance(kind, T.StringType):
        return value.string(), nil | value.is_string()
    if isinstance(kind, WHOLE):
        return F.when(value.number() < 0, F.ceil(value.number())).otherwise(F.floor(value.number())).cast(kind), nil | value.is_number()
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return value.number().cast(kind), nil | value.is_number()
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.boolean(), value.number() > 0), nil | value.is_bool() | value.is_number()
    if isinstance(kind, T.BinaryType):
        made = F.try_to_binary(value.string(), F.lit("base64"))
        return made, nil | (value.is_string() & made.isNotNull())
    if isinstance(kind, T.VariantType):
        return value.variant(), F.lit(True)
    if isinstance(kind, T.ArrayType):
        items = value.each(lambda v: _converted(v, kind.elementType)[0])
        fits = F.coalesce(F.forall(value.each(lambda v: _converted(v, kind.elementType)[1]), lambda x: x), F.lit(False))
        return items, nil | (value.is_array() & fits)
    if isinstance(kind, T.MapType):
        items = F.transform_values(value.map(), lambda _, v: _converted(Val(v, T.VariantType()), kind.valueType)[0])
        return items, nil | value.is_object()
    if isinstance(kind, T.StructType):
        parts = {f.name: _converted(value.get(f.name), f.dataType) for f in kind.fields}
        made = F.struct(*[c.cast(kind[n].dataType).alias(n) for n, (c, _) in parts.items()])
        fits = value.is_object()
        for _, ok in parts.values():
            fits = fits & ok
        return F.when(value.is_object(), made), nil | fits
    raise DecodeError(f"cannot decode to {kind.simpleString()}")


def decode_column(value: Val, schema: T.StructType) -> Column:
    """The typed struct, NULL where a kind does not fit."""
    made, fits = _converted(value, schema)
    return F.when(fits, made)


def decode(value: Any, kind: T.DataType, path: str = "$") -> Any:
    """The same on one plain value; DecodeError names the place."""

    def wrong() -> DecodeError:
        return DecodeError(f"{path}: cannot decode {type(value).__name__} to {kind.simpleString()}")

    if value is None:
        return None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return value
    if isinstance(kind, WHOLE) and number:
        return int(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)) and number:
        return float(value)
    if isinstance(kind, T.BooleanType) and (number or isinstance(value, bool)):
        return value if isinstance(value, bool) else value > 0
    if isinstance(kind, T.BinaryType) and isinstance(value, str):
        try:
            return base64.b64decode(value, validate=True)
        except ValueError:
            raise wrong() from None
    if isinstance(kind, T.VariantType):
        return value
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [decode(v, kind.elementType, f"{path}[{k}]") for k, v in enumerate(value)]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: decode(v, kind.valueType, f"{path}.{k}") for k, v in value.items()}
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return {f.name: decode(value.get(f.name), f.dataType, f"{path}.{f.name}") for f in kind.fields}
    raise wrong()
