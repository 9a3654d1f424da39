"""Document values as Spark Columns.

A `Val` is a Column with what is known of its kind. A typed Val (struct, array, string,
number, boolean column) answers questions of kind while the plan is made; a VARIANT one asks
at run time. A NULL field of a struct is a present JSON null; of a VARIANT, SQL NULL is
an absent value and a variant null a JSON null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.values import ABSENT, Flags, format_float, plain, string_of


class NotLowerable(Exception):
    """The construct has no Column form; the interpreter runs it."""



def lit_bool(x: bool) -> Column:
    return F.lit(x)


def format_double(c: Column) -> Column:
    """A double as the shortest decimal text without an exponent."""
    text = c.cast("string")
    whole = F.when((c == F.floor(c)) & (F.abs(c) < 1e18), c.try_cast("bigint").cast("string"))
    special = F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf")
    long = F.rtrim(F.rtrim(F.format_string("%.330f", c), F.lit("0")), F.lit("."))
    return F.coalesce(special, whole, F.when(text.contains("E"), long), text)


def parse_double(c: Column) -> Column:
    """The number a text spells, else NULL."""
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of a value that is computed once, however often it is named and in whatever lambda."""
    return F.get(F.transform(F.array(value), body), 0)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Val:
    """A value of static kind: null, bool, num, str, bytes, time, arr, obj or any (VARIANT)."""

    def __init__(self, col: Column, dtype: T.DataType | None, never_null: bool = False, const=ABSENT, origin: Val | None = None) -> None:
        #: const: the constant it was made of; origin: what an object map was made of, which tells the kind of other values.
        self.col, self.dtype, self.never_null, self.const, self.origin = col, dtype, never_null, const, origin
        #: A column with the VARIANT's schema, where it was computed already.
        self.tag: Column | None = None

    # kinds
    @property
    def kind(self) -> str:
        t = self.dtype
        if t is None or isinstance(t, T.NullType):
            return "null"
        for kind, types in (("any", T.VariantType), ("bool", T.BooleanType), ("num", NUMERIC), ("str", (T.StringType, T.CharType, T.VarcharType)), ("bytes", T.BinaryType), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType)), ("arr", T.ArrayType), ("obj", (T.StructType, T.MapType))):
            if isinstance(t, types):
                return kind
        raise NotLowerable(f"type {t}")

    def _tag(self) -> Column:
        return F.schema_of_variant(self.col) if self.tag is None else self.tag

    def is_null(self) -> Column:
        """A JSON null (an absent value is not)."""
        if self.origin is not None:
            return self.origin.is_null()
        if self.kind == "null":
            return lit_bool(True)
        if self.kind == "any":
            return F.coalesce(F.is_variant_null(self.col), lit_bool(False))
        return lit_bool(False) if self.never_null else self.col.isNull()

    def is_nil(self) -> Column:
        return self.col.isNull() | self.is_null() if self.kind == "any" else self.is_null()

    def _is(self, kind: str) -> Column:
        if self.origin is not None and kind != "obj":
            return self.origin._is(kind)
        if self.kind == "any":
            tag = self._tag()
            test = {
                "str": lambda: tag == "STRING",
                "bool": lambda: tag == "BOOLEAN",
                "arr": lambda: tag.startswith("ARRAY"),
                "obj": lambda: tag.startswith("OBJECT"),
                "num": lambda: tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL"),
            }[kind]()
            return F.coalesce(test, lit_bool(False))
        if self.kind != kind:
            return lit_bool(False)
        return lit_bool(True) if self.never_null else self.col.isNotNull()

    def is_string(self) -> Column:
        return self._is("str")

    def is_number(self) -> Column:
        return self._is("num")

    def is_bool(self) -> Column:
        return self._is("bool")

    def is_array(self) -> Column:
        return self._is("arr")

    def is_object(self) -> Column:
        return self._is("obj")

    # contents, NULL for another kind
    def string(self) -> Column:
        if self.origin is not None:
            return self.origin.string()
        if self.kind == "any":
            return F.when(self.is_string(), F.try_variant_get(self.col, "$", "string"))
        return self.col.cast("string") if self.kind == "str" else F.lit(None).cast("string")

    def number(self) -> Column:
        if self.origin is not None:
            return self.origin.number()
        if self.kind == "any":
            return F.when(self.is_number(), F.try_variant_get(self.col, "$", "double"))
        return self.col.cast("double") if self.kind == "num" else F.lit(None).cast("double")

    def boolean(self) -> Column:
        if self.origin is not None:
            return self.origin.boolean()
        if self.kind == "any":
            return F.when(self.is_bool(), F.try_variant_get(self.col, "$", "boolean"))
        return self.col if self.kind == "bool" else F.lit(None).cast("boolean")

    def array(self) -> tuple[Column, T.DataType]:
        """The array column and its element type."""
        if self.origin is not None:
            return self.origin.array()
        if self.kind == "any":
            return self.col.try_cast("array<variant>"), T.VariantType()
        if self.kind == "arr":
            return self.col, self.dtype.elementType
        return F.lit(None).cast("array<variant>"), T.VariantType()

    def each(self, make: Callable[[Val], Column]) -> Column:
        """An array of what `make` gives for each element; NULL for another kind."""
        arr, kind = self.array()
        return F.transform(arr, lambda x: make(Val(x, kind)))

    def map(self) -> Column:
        """map<string,variant> of an object, NULL for another kind."""
        if self.kind == "any":
            return self.col.try_cast("map<string,variant>")
        if self.kind == "obj":
            if isinstance(self.dtype, T.MapType) and isinstance(self.dtype.valueType, T.VariantType):
                return self.col
            return F.try_variant_get(self.variant(), "$", "map<string,variant>")
        return F.lit(None).cast("map<string,variant>")

    def variant(self) -> Column:
        k = self.kind
        if self.origin is not None:
            return F.when(self.col.isNotNull(), F.to_variant_object(self.col)).otherwise(self.origin.variant())
        if k == "any":
            return self.col
        if k == "null":
            return F.parse_json(F.lit("null"))
        if k in ("obj", "arr"):
            return F.coalesce(F.to_variant_object(self.col), F.parse_json(F.lit("null")))
        if k == "num":
            return F.coalesce(self.col.cast("double").cast("variant"), F.parse_json(F.lit("null")))
        if k == "time":
            return F.coalesce(self.col.cast("string").cast("variant"), F.parse_json(F.lit("null")))
        return F.coalesce(self.col.cast("variant"), F.parse_json(F.lit("null")))

    # structure
    @property
    def fields(self) -> list[str] | None:
        """Names of a struct's fields; None where only the row knows."""
        return self.dtype.names if isinstance(self.dtype, T.StructType) else None

    def keys(self) -> Column:
        if self.fields is not None:
            return F.array(*map(F.lit, self.fields)) if self.fields else F.array().cast("array<string>")
        if isinstance(self.dtype, T.MapType):
            return F.map_keys(self.col)
        return F.map_keys(self.map())

    def has(self, name: str) -> Column:
        if self.fields is not None:
            return lit_bool(name in self.fields) & (lit_bool(True) if self.never_null else self.col.isNotNull())
        if isinstance(self.dtype, T.MapType):
            return F.coalesce(F.map_contains_key(self.col, name), lit_bool(False))
        if self.kind == "any":
            return F.try_variant_get(self.col, _json_path(name), "variant").isNotNull()
        return lit_bool(False)

    def get(self, name: str) -> Val:
        if self.fields is not None:
            if name not in self.fields:
                return Val(F.lit(None).cast("variant"), T.VariantType())
            return Val(self.col.getField(name), self.dtype[name].dataType)
        if isinstance(self.dtype, T.MapType):
            return Val(F.try_element_at(self.col, F.lit(name)), self.dtype.valueType)
        if self.kind == "any":
            return Val(F.try_variant_get(self.col, _json_path(name), "variant"), T.VariantType())
        return Val(F.lit(None).cast("variant"), T.VariantType())

    def at(self, index: int) -> Val:
        if index < 0:
            return Val(F.lit(None).cast("variant"), T.VariantType())
        if self.kind == "any":
            return Val(F.try_variant_get(self.col, f"$[{index}]", "variant"), T.VariantType())
        arr, kind = self.array()
        return Val(F.get(arr, index), kind)

    def path(self, path) -> Val:
        from docloom.plans.paths import Index, Key

        value = self
        for step in path.steps:
            if isinstance(step, Index):
                value = value.at(step.at)
            elif isinstance(step, Key):
                value = value.get(step.name)
            else:
                raise NotLowerable("indirect path")
        return value

    # coercions
    def string_of(self) -> Column:
        k = self.kind
        if k == "str":
            return F.coalesce(self.col.cast("string"), F.lit(""))
        if k == "null":
            return F.lit("")
        if k == "bool":
            return F.coalesce(self.col.cast("string"), F.lit(""))
        if k == "num":
            whole = isinstance(self.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            return F.coalesce(self.col.cast("string") if whole else format_double(self.col.cast("double")), F.lit(""))
        if k == "any":
            if self.tag is None:
                return let(self.col, lambda v: tagged(Val(v, self.dtype), lambda x: x.string_of()))
            scalar = F.coalesce(self.string(), self.boolean().cast("string"), let(self.number(), format_double))
            return F.when(self.is_nil(), F.lit("")).otherwise(F.coalesce(scalar, self.variant().cast("string")))
        if k == "time":
            return F.coalesce(self.col.cast("string"), F.lit(""))
        raise NotLowerable("text of an array or object")

    def root_number_of(self, flags: Flags = Flags()) -> Column:
        text = F.lit(None).cast("double") if flags.strict else parse_double(self.string())
        return F.coalesce(self.number(), self.boolean().cast("int").cast("double"), text, F.lit(0.0))

    def root_bool_of(self) -> Column:
        return F.coalesce(self.boolean(), self.number() > 0, self.string() == "true", lit_bool(False))

    def rule_number_of(self) -> Column:
        text = F.when(self.string() == "true", 1.0).otherwise(parse_double(self.string()))
        return F.coalesce(self.number(), self.boolean().cast("int").cast("double"), text, F.lit(0.0))

    def rule_bool_of(self) -> Column:
        text = ~self.string().isin("false", "0", "", "False", "FALSE")
        return F.when(self.is_nil(), False).otherwise(F.coalesce(self.boolean(), self.number() != 0, text, lit_bool(True)))

    def condition(self) -> Column:
        if self.kind in ("num", "str", "arr", "obj", "bytes", "time"):
            return lit_bool(True) if self.never_null else self.col.isNotNull()
        return ~self.is_nil() & F.coalesce(self.boolean(), lit_bool(True))

    def number_or_zero(self) -> Column:
        """By type assertion: another kind is 0."""
        return F.coalesce(self.number(), F.lit(0.0))

    def string_or_empty(self) -> Column:
        return F.coalesce(self.string(), F.lit(""))

    def root_equal(self, other: Val, flags: Flags = Flags()) -> Column:
        """Equality by the kind of this side."""
        text = self.string_of() == other.string_of()
        number = self.number() == other.root_number_of(flags)
        boolean = self.boolean() == other.root_bool_of()
        k = self.kind
        if k == "num":
            return F.when(self.is_null(), text).otherwise(number) if not self.never_null else number
        if k == "bool":
            return F.when(self.is_null(), text).otherwise(boolean) if not self.never_null else boolean
        if k == "any":
            return F.when(self.is_number(), number).when(self.is_bool(), boolean).otherwise(text)
        return text


def _json_path(name: str) -> str:
    if "'" not in name:
        return f"$['{name}']"
    if '"' not in name:
        return f'$["{name}"]'
    raise NotLowerable("a key with both quotes")


def constant_of(value: Val):
    if value.const is ABSENT:
        raise NotLowerable("an argument that is not constant")
    return value.const


MAP = T.MapType(T.StringType(), T.VariantType())


def as_object(value: Val) -> Val:
    """The value as a map of variants, to be written to; not an object: a null map that knows its origin."""
    if value.origin is not None or value.dtype == MAP:
        return value
    return Val(value.map(), MAP, origin=value)


def with_key(value: Val, name: Column | str, new: Val, when: Column | None = None) -> Val:
    """The object with a key written, where `when` holds."""
    entry = F.create_map(F.lit(name) if isinstance(name, str) else name, F.coalesce(new.variant(), F.parse_json(F.lit("null"))))
    if isinstance(name, str):
        out = F.map_concat(F.map_filter(value.col, lambda k, _: k != name), entry)
    else:  # a key that only the row knows is made once, not for each key that it is compared with
        out = let(entry, lambda e: F.map_concat(F.map_filter(value.col, lambda k, _: ~F.map_contains_key(e, k)), e))
    return Val(out if when is None else F.when(when, out).otherwise(value.col), MAP, origin=value.origin)


def without_keys(value: Val, names: list[Column | str]) -> Val:
    """The object without some keys."""
    if all(isinstance(n, str) for n in names):
        return Val(F.map_filter(value.col, lambda k, _: ~k.isin(*names)), MAP, origin=value.origin)
    made = F.array(*(F.lit(n) if isinstance(n, str) else n for n in names))
    return Val(let(made, lambda gone: F.map_filter(value.col, lambda k, _: ~F.array_contains(gone, k))), MAP, origin=value.origin)


def tagged(value: Val, body: Callable[[Val], Column]) -> Column:
    """What `body` makes of a VARIANT whose kind is found once."""
    def known(tag: Column) -> Column:
        out = Val(value.col, value.dtype, value.never_null, value.const)
        out.tag = tag
        return body(out)

    return let(F.schema_of_variant(value.col), known)


def literal(value) -> Val:
    made = _literal(plain(value))
    made.const = plain(value)
    return made


def _literal(value) -> Val:
    if value is None:
        return Val(F.lit(None).cast("variant"), None)
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType(), True)
    if isinstance(value, float):
        return Val(F.lit(value), T.DoubleType(), True)
    if isinstance(value, str):
        return Val(F.lit(value), T.StringType(), True)
    return Val(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))), T.VariantType(), True)


def of(col: Column, dtype: T.DataType) -> Val:
    return Val(col, dtype)


__all__ = ["NotLowerable", "Val", "format_double", "format_float", "let", "literal", "tagged", "as_object", "constant_of", "of", "parse_double", "string_of", "with_key", "without_keys"]
