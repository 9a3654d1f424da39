"""Schemas from typed structs, whose fields' metadata carry the rules, and structs from schemas."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

TEXT = ("maxLength", "minLength", "default", "pattern", "format", "enum")
NUMBER = ("enum", "maximum", "minimum", "default", "multipleOf")
LIST = ("maxItems", "minItems", "uniqueItems", "default")
#: Metadata keys that are copied as they are.
PASSED: set[str] = set()


def pass_through(*names: str) -> None:
    """Let metadata keys of a user's own into generated schemas."""
    PASSED.update(names)


def schema_of(kind: T.DataType, metadata: dict | None = None) -> dict[str, Any]:
    """The schema a type describes; `inline: true` metadata lifts a struct's fields into its parent."""
    metadata = metadata or {}
    tags = lambda names: {k: metadata[k] for k in names if k in metadata}
    out: dict[str, Any]
    if isinstance(kind, T.StructType):
        properties: dict[str, Any] = {}
        required: list[str] = []
        for f in kind.fields:
            made = schema_of(f.dataType, f.metadata)
            if f.metadata.get("inline") and isinstance(f.dataType, T.StructType):
                properties |= made["properties"]
                required += made.get("required", [])
                continue
            properties[f.name] = made
            if f.metadata.get("required") in (True, "true"):
                required.append(f.name)
        out = {"type": "object", "properties": properties}
        if required:
            out["required"] = required
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": schema_of(kind.elementType)} | tags(LIST)
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "properties": {}, "additionalProperties": schema_of(kind.valueType)}
    elif isinstance(kind, (T.StringType, T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = {"type": "string"} | tags(TEXT)
    elif isinstance(kind, T.BooleanType):
        out = {"type": "boolean"} | tags(("default",))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = {"type": "integer"} | tags(NUMBER)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        out = {"type": "number"} | tags(NUMBER)
    else:
        out = {}
    return out | {k: metadata[k] for k in sorted(PASSED) if k in metadata}


def struct_of(schema: dict[str, Any]) -> T.DataType:
    """The type of documents of a closed schema; VARIANT where it leaves the kind open."""
    name = schema.get("type")
    if name == "object":
        properties = schema.get("properties", schema.get("props"))
        rest = schema.get("additionalProperties")
        if properties:
            return T.StructType([T.StructField(k, struct_of(v) if isinstance(v, dict) else T.VariantType()) for k, v in properties.items()])
        return T.MapType(T.StringType(), struct_of(rest) if isinstance(rest, dict) else T.VariantType())
    if name == "array":
        return T.ArrayType(struct_of(schema.get("items", {})))
    simple = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}
    return simple.get(name, T.VariantType())
