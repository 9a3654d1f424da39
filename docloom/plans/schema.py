"""JSON schemas with extensions: compiled on the driver to an ordered list of steps.

Every step has two forms: `run` works on a plain-Python document (in place, collecting
errors) and `lower` on a `Val`, as Columns. The Column form is what executors run; what
has none (`NotLowerable`) goes through the interpreter in Arrow batches.

Order of keywords: by priority, then as the document has them.
"""

from __future__ import annotations

import copy
import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import formats, rules, templates
from docloom.functions.values import ABSENT, Flags, format_float, plain, print_value, root_bool_of, root_equal, root_number_of, string_of
from docloom.plans.columns import NotLowerable, Val, as_object, literal, with_key, without_keys
from docloom.plans.paths import Index, Key, parse_path
from docloom.plans.rules.interpreter import Machine
from docloom.plans.rules.lower import Lowerer, assigned
from docloom.plans.rules.parser import Call, Method, Node, RuleError, parse_program


class SchemaError(ValueError):
    """A schema that does not compile."""


# Keywords that say nothing, and the order of those that depend on others.
IGNORED = {"title", "comment", "$comment", "description", "$id", "$schema", "id", "examples"}
PRIORITY = {"switch": 1, "if": 1, "properties": 1, "props": 1, "maximum": 1, "minimum": 1, "required": 2, "defaultVals": 3}
TYPES = ("string", "integer", "number", "bool", "boolean", "object", "array", "any")


@dataclass
class Context:
    """One run over one document."""

    flags: Flags = Flags()
    root: Any = None
    errors: list[tuple[str, str]] = field(default_factory=list)

    def add(self, path: str, info: str) -> None:
        self.errors.append((path, info))

    def fork(self) -> Context:
        return Context(self.flags, self.root)


ERROR = "struct<path:string,info:string>"


class Errors:
    """Errors as Columns: single conditional ones and arrays of them."""

    def __init__(self) -> None:
        self.parts: list[tuple[Column, Column | str, Column | str] | Column] = []

    def one(self, bad: Column, path: str | Column, info: str | Column) -> None:
        self.parts.append((bad, path, info))

    def many(self, array: Column) -> None:
        self.parts.append(array)

    def take(self, other: Errors, when: Column | None = None) -> None:
        for part in other.parts:
            if isinstance(part, tuple):
                self.parts.append(part if when is None else (when & part[0], *part[1:]))
            else:
                self.parts.append(part if when is None else F.when(when, part))

    def ok(self) -> Column:
        out = None
        for part in self.parts:
            bad = part[0] if isinstance(part, tuple) else F.size(part) > 0
            good = ~F.coalesce(bad, F.lit(False))
            out = good if out is None else out & good
        return F.lit(True) if out is None else out

    def array(self) -> Column:
        none = F.array().cast(f"array<{ERROR}>")
        runs: list[Column] = []
        singles: list[Column] = []

        def close() -> None:
            if singles:
                runs.append(F.array_compact(F.array(*singles)))
                singles.clear()

        for part in self.parts:
            if isinstance(part, tuple):
                bad, path, info = part
                text = lambda x: F.lit(x) if isinstance(x, str) else x
                singles.append(F.when(bad, F.struct(text(path).alias("path"), text(info).alias("info"))))
            else:
                close()
                runs.append(F.coalesce(part, none))
        close()
        return F.concat(*runs) if len(runs) > 1 else runs[0] if runs else none


class Lowering:
    """Where Columns are made: `bind` names an intermediate value so that it is computed once."""

    def __init__(self, bind: Callable[[list[Column]], list[Column]] | None, flags: Flags, root: Schema | None, depth: int) -> None:
        self._bind, self.flags, self.root, self.depth = bind, flags, root, depth

    def bind(self, value: Val) -> Val:
        if self._bind is None:
            raise NotLowerable("a write inside an array")
        return Val(self._bind([value.col])[0], value.dtype, value.never_null, value.const, value.origin)

    def written(self, value: Val) -> Val:
        """The value as an object to be written to, which is made once for all that read it."""
        out = as_object(value)
        return out if out is value else self.bind(out)

    def once(self, values: list[Val]) -> list[Val]:
        """The values with VARIANTs, and what kind they are, computed once for all that ask."""
        at = [k for k, v in enumerate(values) if v.kind == "any" and v.tag is None and v.origin is None]
        if self._bind is None or not at:
            return values
        cols = self._bind([values[k].col for k in at])
        tags = self._bind([F.schema_of_variant(c) for c in cols])
        out = list(values)
        for k, col, tag in zip(at, cols, tags, strict=True):
            out[k] = Val(col, values[k].dtype, values[k].never_null, values[k].const)
            out[k].tag = tag
        return out

    def inner(self) -> Lowering:
        return Lowering(None, self.flags, self.root, self.depth)

    def deeper(self) -> Lowering:
        if self.depth <= 0:
            raise NotLowerable("a reference nested too deep")
        return Lowering(self._bind, self.flags, self.root, self.depth - 1)


class Step:
    """A keyword at a place of the schema."""

    writes = False

    def run(self, ctx: Context, value: Any) -> Any:
        raise NotImplementedError

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        raise NotLowerable(type(self).__name__)

    def children(self) -> list[Schema]:
        return []

    def child(self, name: str) -> Step | Schema | None:
        return None


class Check(Step):
    """A step that only tests: `bad` and its message."""

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        errors = Errors()
        self.test(low, value, errors)
        return value, errors

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        raise NotLowerable(type(self).__name__)


class Schema(Step):
    """A list of steps: a schema object, or `allOf`."""

    def __init__(self, path: str, steps: list[tuple[str, Step]]) -> None:
        self.path, self.steps = path, steps

    def run(self, ctx: Context, value: Any) -> Any:
        for _, step in self.steps:
            step.run(ctx, value)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        errors = Errors()
        for _, step in self.steps:
            value, more = step.lower(low, value)
            errors.take(more)
        return value, errors

    def children(self) -> list[Schema]:
        return [c for _, s in self.steps for c in s.children()]

    @property
    def any_writes(self) -> bool:
        return any(s.writes for _, s in self.steps) or any(c.any_writes for c in self.children())

    @property
    def tests(self) -> bool:
        """Whether any step does something of its own."""
        return any(not isinstance(s, Inert) for _, s in self.steps)

    def get(self, name: str) -> Step | None:
        return next((s for n, s in self.steps if n == name), None)

    def child(self, name: str) -> Step | Schema | None:
        return self.get(name)


@dataclass
class Place:
    """What a constructor sees: its path, the sibling steps made so far, and the enclosing kind."""

    path: str
    siblings: Schema
    raw: dict
    in_if: bool = False
    compiler: Compiler | None = None


KEYWORDS: dict[str, Callable[[Any, Place], Step]] = {}


def keyword(*names: str):
    def register(make):
        for name in names:
            KEYWORDS[name] = make
        return make

    return register


def register_validator(name: str, make: Callable[[Any, Place], Step]) -> None:
    """Add a keyword, or override one."""
    KEYWORDS[name] = make


def ignore_keywords(*names: str) -> None:
    """Let keywords be that say nothing to this engine."""
    IGNORED.update(names)


class Compiler:
    def __init__(self, flags: Flags = Flags(), ignored: set[str] | None = None) -> None:
        self.flags, self.ignored = flags, IGNORED | (ignored or set())

    def compile(self, spec: Any, path: str = "$", in_if: bool = False) -> Schema:
        if isinstance(spec, list):
            return Schema(path, [("allOf", make_all_of(spec, Place(path, Schema(path, []), {}, in_if, self)))])
        if not isinstance(spec, dict):
            raise SchemaError(f"{path}: a schema must be an object, not {spec!r}")
        out = Schema(path, [])
        names = sorted(spec, key=lambda k: PRIORITY.get(k, 0))
        made = []
        for name in names:
            if name in self.ignored:
                continue
            if name not in KEYWORDS:
                raise SchemaError(f"{path}: unknown keyword {name!r}")
            step = KEYWORDS[name](plain(spec[name]), Place(path, out, spec, in_if, self))
            made.append((name, step))
            out.steps = made
        return out


def need(condition: bool, place: Place, what: str) -> None:
    if not condition:
        raise SchemaError(f"{place.path}: {what}")


def number_arg(value: Any, place: Place, name: str) -> float:
    need(isinstance(value, float), place, f"{name} must be a number")
    return value


def kind_name(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    return {str: "string", float: "float64", int: "int", dict: "map[string]interface {}", list: "[]interface {}"}.get(type(value), type(value).__name__)


def kind_column(v: Val) -> Column:
    return F.when(v.is_string(), "string").when(v.is_bool(), "bool").when(v.is_number(), "float64").when(v.is_object(), "map[string]interface {}").when(v.is_array(), "[]interface {}")


# ---- predicates -------------------------------------------------------------------------


def matches_type(name: str, value: Any) -> bool:
    if value is None or name == "any":
        return True
    if name == "string":
        return isinstance(value, str)
    if name in ("bool", "boolean"):
        return isinstance(value, bool)
    if name == "number":
        return isinstance(value, (float, int)) and not isinstance(value, bool)
    if name == "integer":
        return isinstance(value, (float, int)) and not isinstance(value, bool) and float(value).is_integer()
    return isinstance(value, dict if name == "object" else list)


def type_column(name: str, v: Val) -> Column:
    test = {
        "any": lambda: F.lit(True),
        "string": v.is_string,
        "bool": v.is_bool,
        "boolean": v.is_bool,
        "number": v.is_number,
        "integer": lambda: v.is_number() & (v.number() == F.floor(v.number())),
        "object": v.is_object,
        "array": v.is_array,
    }[name]()
    return v.is_nil() | test


@dataclass
class Type(Check):
    path: str
    names: tuple[str, ...]
    text: str

    def run(self, ctx: Context, value: Any) -> None:
        if any(matches_type(n, value) for n in self.names):
            return
        if len(self.names) > 1:
            ctx.add(self.path, f"type should be one of {self.text}")
        elif self.names[0] == "integer" and isinstance(value, float):
            ctx.add(self.path, f"type should be integer, but float:{print_value(value)}")
        else:
            ctx.add(self.path, f"Invalid type, expected: {self._said} , given: {kind_name(value)}")

    @property
    def _said(self) -> str:
        return {"bool": "boolean"}.get(self.names[0], self.names[0])

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        good = type_column(self.names[0], value)
        for n in self.names[1:]:
            good = good | type_column(n, value)
        if len(self.names) > 1:
            return errors.one(~good, self.path, f"type should be one of {self.text}")
        info: Column = F.concat(F.lit(f"Invalid type, expected: {self._said} , given: "), kind_column(value))
        if self.names[0] == "integer":
            number = F.when(value.is_number(), F.concat(F.lit("type should be integer, but float:"), literal_text(value)))
            info = F.coalesce(number, info)
        errors.one(~good, self.path, info)


def literal_text(value: Val) -> Column:
    return Val(value.number(), T.DoubleType()).string_of()


@keyword("type")
def _type(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str), place, "type must be a string")
    names = tuple(n.strip() for n in arg.split("|"))
    for n in names:
        need(n in TYPES, place, f"invalid type {n!r}")
    return Type(place.path, names, arg)


@dataclass
class Length(Check):
    path: str
    limit: float
    largest: bool
    strings: bool = True
    arrays: bool = True
    decoded: bool = False

    def _size(self, value: Any) -> int | None:
        if isinstance(value, str) and self.strings:
            n = len(value.encode("utf-8", "surrogatepass"))
            return n // 4 * 3 if self.decoded else n
        return len(value) if isinstance(value, list) and self.arrays else None

    @property
    def info(self) -> str:
        if self.decoded:
            return f"length is invalid, max length is  {int(self.limit)}" if self.largest else f"length is invalid ,min length is  {int(self.limit)}"
        return f"length must be {'less' if self.largest else 'larger'} or equal than {int(self.limit)}"

    def run(self, ctx: Context, value: Any) -> None:
        n = self._size(value)
        if n is not None and (n > self.limit if self.largest else n < self.limit):
            ctx.add(self.path, self.info)

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        n = F.lit(None).cast("int")
        if self.strings and value.kind in ("str", "any"):
            n = F.octet_length(value.string())
            n = F.floor(n / 4) * 3 if self.decoded else n
        if self.arrays and value.kind in ("arr", "any"):
            size = F.size(value.array()[0])
            n = F.coalesce(n, F.when(value.is_array(), size))
        errors.one(n > self.limit if self.largest else n < self.limit, self.path, self.info)


for _name, _largest, _options in (("maxLength", True, {}), ("minLength", False, {}), ("maxB64DLen", True, {"arrays": False, "decoded": True}), ("minB64DLen", False, {"arrays": False, "decoded": True})):
    KEYWORDS[_name] = lambda arg, place, n=_name, b=_largest, o=_options: Length(place.path, number_arg(arg, place, n), b, **o)


@dataclass
class Items(Check):
    """maxItems and minItems."""

    path: str
    limit: float
    largest: bool

    @property
    def info(self) -> str:
        return f" {'max' if self.largest else 'min'} length is {int(self.limit)}"

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, list) and (len(value) > self.limit if self.largest else len(value) < self.limit):
            ctx.add(self.path, self.info)

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        n = F.when(value.is_array(), F.size(value.array()[0]))
        errors.one(n > self.limit if self.largest else n < self.limit, self.path, self.info)


for _name, _largest in (("maxItems", True), ("minItems", False)):
    KEYWORDS[_name] = lambda arg, place, n=_name, b=_largest: Items(place.path, number_arg(arg, place, n), b)


@dataclass
class Bound(Check):
    """maximum, minimum and the number forms of their exclusive siblings."""

    path: str
    limit: float
    largest: bool
    strict: bool
    info: str

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, bool) or not isinstance(value, (float, int)):
            return
        beyond = value > self.limit if self.largest else value < self.limit
        if beyond or (self.strict and value == self.limit):
            ctx.add(self.path, self.info)

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        x = value.number()
        if self.largest:
            bad = x >= self.limit if self.strict else x > self.limit
        else:
            bad = x <= self.limit if self.strict else x < self.limit
        errors.one(bad, self.path, self.info)


@keyword("maximum")
def _maximum(arg: Any, place: Place) -> Step:
    limit = number_arg(arg, place, "maximum")
    strict = place.raw.get("exclusiveMaximum") is True
    return Bound(place.path, limit, True, strict, ("value must be  < " if strict else "value must be <= than ") + format_float(limit))


@keyword("minimum")
def _minimum(arg: Any, place: Place) -> Step:
    limit = number_arg(arg, place, "minimum")
    strict = place.raw.get("exclusiveMinimum") is True
    return Bound(place.path, limit, False, strict, ("value must be larger than " if strict else "value must be larger or equal than ") + format_float(limit))


class Inert(Step):
    """A keyword that another one reads, or that holds schemas."""

    def __init__(self, arg: Any = None, schemas: dict[str, Schema] | None = None) -> None:
        self.arg, self.schemas = arg, schemas or {}

    def run(self, ctx: Context, value: Any) -> None:
        return None

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        return value, Errors()

    def child(self, name: str) -> Schema | None:
        return self.schemas.get(name)


def _exclusive(largest: bool):
    def make(arg: Any, place: Place) -> Step:
        if isinstance(arg, bool):
            return Inert(arg)
        name = "exclusiveMaximum" if largest else "exclusiveMinimum"
        need(isinstance(arg, float), place, f"{name} must be a number or a boolean")
        return Bound(place.path, arg, largest, True, f"value should be {'<' if largest else '>'} {print_value(arg)}")

    return make


KEYWORDS["exclusiveMaximum"], KEYWORDS["exclusiveMinimum"] = _exclusive(True), _exclusive(False)


@dataclass
class Enum(Check):
    path: str
    wanted: list

    def run(self, ctx: Context, value: Any) -> None:
        if value is None or any(root_equal(w, value, ctx.flags) for w in self.wanted):
            return
        ctx.add(self.path, self.info)

    @property
    def info(self) -> str:
        return f"value is invalid , shoule be one of {print_value(self.wanted)}"

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        if value.kind in ("arr", "obj"):
            raise NotLowerable("enum of arrays or objects")
        good = value.is_nil()
        texts = [string_of(w) for w in self.wanted if isinstance(w, str) or w is None]
        if texts:
            good = good | value.string_of().isin(texts)
        for w in self.wanted:
            if not isinstance(w, str) and w is not None:
                good = good | literal(w).root_equal(value, low.flags)
        errors.one(~good, self.path, self.info)


@keyword("enum", "enums")
def _enum(arg: Any, place: Place) -> Step:
    need(isinstance(arg, list), place, "enum must be an array")
    return Enum(place.path, arg)


@dataclass
class ConstText(Check):
    path: str
    text: str

    def run(self, ctx: Context, value: Any) -> None:
        if string_of(value) != self.text:
            ctx.add(self.path, f"value is invalid , expected: {self.text}")

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        errors.one(value.string_of() != self.text, self.path, f"value is invalid , expected: {self.text}")


@keyword("const")
def _const(arg: Any, place: Place) -> Step:
    return ConstText(place.path, string_of(arg))


@dataclass
class MultipleOf(Check):
    path: str
    unit: float

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, float) and not (value / self.unit).is_integer():
            ctx.add(self.path, f"value must be multipleOf {print_value(self.unit)},but:{print_value(value)}, divide:{print_value(value / self.unit)}")

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        x = value.number()
        ratio = x / self.unit
        text = lambda c: Val(c, T.DoubleType()).string_of()
        errors.one(ratio != F.floor(ratio), self.path, F.concat(F.lit(f"value must be multipleOf {print_value(self.unit)},but:"), text(x), F.lit(", divide:"), text(ratio)))


@keyword("multipleOf")
def _multiple_of(arg: Any, place: Place) -> Step:
    need(number_arg(arg, place, "multipleOf") > 0, place, "multipleOf must be positive")
    return MultipleOf(place.path, arg)


@dataclass
class Required(Check):
    path: str
    names: list[str]

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, dict):
            for n in self.names:
                if n not in value:
                    ctx.add(f"{self.path}.{n}", "field is required")

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        for n in self.names:
            errors.one(value.is_object() & ~value.has(n), f"{self.path}.{n}", "field is required")


def string_list(arg: Any, place: Place, name: str) -> list[str]:
    need(isinstance(arg, list) and all(isinstance(x, str) for x in arg), place, f"{name} must be an array of strings")
    return arg


@keyword("required")
def _required(arg: Any, place: Place) -> Step:
    names = string_list(arg, place, "required")
    closed = next((s for k in ("properties", "props") if isinstance(s := place.siblings.get(k), Properties)), None)
    if closed is not None and not closed.open:
        for n in names:
            need(n in closed.schemas, place, f"required {n!r} is not among the properties")
    return Required(place.path, names)


def go_regex(pattern: str, place: Place | None = None) -> str:
    """A pattern without look-around or back-references, in the form both engines take."""
    if re.search(r"\(\?(=|!|<=|<!)", pattern) or re.search(r"(?<!\\)(\\\\)*\\[1-9]", pattern):
        raise SchemaError(f"{place.path if place else '$'}: unsupported regular expression {pattern!r}")
    return pattern


def python_regex(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern.replace(r"\z", r"\Z")))


def java_regex(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


@dataclass
class Pattern(Check):
    path: str
    pattern: str

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, str) and not python_regex(self.pattern).search(value):
            ctx.add(self.path, f"{value} ,value does not match pattern: {self.pattern}")

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        s = value.string()
        errors.one(~s.rlike(java_regex(self.pattern)), self.path, F.concat(s, F.lit(f" ,value does not match pattern: {self.pattern}")))


@keyword("pattern")
def _pattern(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str), place, "pattern must be a string")
    try:
        python_regex(go_regex(arg, place))
    except re.error as e:
        raise SchemaError(f"{place.path}: {e}") from e
    return Pattern(place.path, arg)


@dataclass
class Format(Check):
    path: str
    name: str

    @property
    def info(self) -> str:
        return f"invalid {self.name}"

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, str) and not formats.FORMATS[self.name][0](value):
            ctx.add(self.path, self.info)

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        text = value.string()
        errors.one(text.isNotNull() & ~formats.column_of(self.name)(text), self.path, self.info)


@keyword("format")
def _format(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str) and arg in formats.FORMATS, place, f"invalid format {arg!r}")
    return Format(place.path, arg)


@dataclass
class UniqueItems(Check):
    path: str
    wanted: bool

    def run(self, ctx: Context, value: Any) -> None:
        if not self.wanted or not isinstance(value, list):
            return
        seen = set()
        for x in value:
            if not isinstance(x, (str, float, bool)):
                return ctx.add(self.path, " items should be comparable type,like [ string boolean number ]")
            key = (isinstance(x, bool), isinstance(x, str), x)
            if key in seen:
                return ctx.add(self.path, " items should be unique")
            seen.add(key)
        return None

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        if not self.wanted:
            return
        arr, kind = value.array()
        scalar = F.forall(arr, lambda x: (lambda v: v.is_string() | v.is_number() | v.is_bool())(Val(x, kind)))
        tagged = value.each(lambda v: F.concat(F.when(v.is_string(), "s").when(v.is_bool(), "b").otherwise("n"), v.string_of()))
        errors.one(value.is_array() & ~scalar, self.path, " items should be comparable type,like [ string boolean number ]")
        errors.one(value.is_array() & scalar & (F.size(F.array_distinct(tagged)) < F.size(arr)), self.path, " items should be unique")


@keyword("uniqueItems")
def _unique(arg: Any, place: Place) -> Step:
    need(isinstance(arg, bool), place, "uniqueItems must be a boolean")
    return UniqueItems(place.path, arg)


@dataclass
class PropertyCount(Check):
    path: str
    limit: float
    largest: bool
    info: str

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, (dict, list)) and (len(value) > self.limit if self.largest else len(value) < self.limit):
            ctx.add(self.path, self.info)

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        n = F.when(value.is_object(), F.size(value.keys())) if value.kind in ("obj", "any") else F.lit(None).cast("int")
        if value.kind in ("arr", "any"):
            n = F.coalesce(n, F.when(value.is_array(), F.size(value.array()[0])))
        errors.one(n > self.limit if self.largest else n < self.limit, self.path, self.info)


@keyword("minProperties")
def _min_properties(arg: Any, place: Place) -> Step:
    limit = number_arg(arg, place, "minProperties")
    return PropertyCount(place.path, limit, False, f"min properties is : {int(limit)}")


@keyword("maxProperties")
def _max_properties(arg: Any, place: Place) -> Step:
    limit = number_arg(arg, place, "maxProperties")
    if place.compiler.flags.strict:  # the quirk: a minimum
        return PropertyCount(place.path, limit, False, f"min properties is : {int(limit)}")
    return PropertyCount(place.path, limit, True, f"max properties is :{int(limit)}")


@dataclass
class Dependencies(Check):
    path: str
    wanted: dict[str, list[str]]

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, dict):
            for key, names in self.wanted.items():
                for n in names if key in value else ():
                    if n not in value:
                        ctx.add(f"{self.path}.{n}", "is required")

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        for key, names in self.wanted.items():
            for n in names:
                errors.one(value.is_object() & value.has(key) & ~value.has(n), f"{self.path}.{n}", "is required")


@keyword("dependencies")
def _dependencies(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "dependencies must be an object")
    return Dependencies(place.path, {k: string_list(v, place, "dependencies") for k, v in arg.items()})


# ---- comparisons of paths ---------------------------------------------------------------


@dataclass
class Compare(Check):
    """{path: right side}: `test_one` in Python, `lower_one` as a Column; both say whether it holds."""

    path: str
    info: str
    pairs: list[tuple[Any, Any]]
    holds: Callable[[Any, Any, Any, Flags], bool]
    holds_column: Callable[[Val, Any, Val, Flags], Column]
    show: Callable[[Any], str]
    objects_only: bool = False
    show_column: Callable[[Any, Val, Flags], Column] | None = None

    def run(self, ctx: Context, value: Any) -> None:
        if self.objects_only and not isinstance(value, dict):
            return
        for p, right in self.pairs:
            found = p.get(value)
            if not self.holds(None if found is ABSENT else found, right, value, ctx.flags):
                ctx.add(f"{self.path}.{p.text}", self.info + self.show((right, value, ctx.flags)))

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        for p, right in self.pairs:
            bad = ~F.coalesce(self.holds_column(value.path(p), right, value, low.flags), F.lit(False))
            if self.objects_only:
                bad = value.is_object() & bad
            info = F.concat(F.lit(self.info), self.show_column(right, value, low.flags)) if self.show_column else self.info + self.show((right, None, low.flags))
            errors.one(bad, f"{self.path}.{p.text}", info)


def pairs_of(arg: Any, place: Place, parse: Callable[[Any], Any]) -> list:
    need(isinstance(arg, dict), place, "an object of paths is needed")
    return [(parse_path(k), parse(v)) for k, v in arg.items()]


def _text_compare(info: str, holds: Callable[[str, str], bool], column: Callable[[Column, str], Column]):
    def make(arg: Any, place: Place) -> Step:
        return Compare(place.path, info, pairs_of(arg, place, string_of), lambda a, r, d, f: holds(a if isinstance(a, str) else "", r), lambda a, r, d, f: column(a.string_or_empty(), r), lambda x: x[0])

    return make


KEYWORDS["startWiths"] = _text_compare("should start with ", str.startswith, lambda c, r: c.startswith(r))
KEYWORDS["endWiths"] = _text_compare("should end with ", str.endswith, lambda c, r: c.endswith(r))
KEYWORDS["containss"] = _text_compare("should contains ", lambda a, r: r in a, lambda c, r: c.contains(r))
KEYWORDS["patterns"] = lambda arg, place: Compare(place.path, "should match pattern ", pairs_of(arg, place, lambda p: go_regex(string_of(p), place)), lambda a, r, d, f: bool(python_regex(r).search(a if isinstance(a, str) else "")), lambda a, r, d, f: a.string_or_empty().rlike(java_regex(r)), lambda x: x[0])


def _length_compare(info: str, largest: bool):
    def make(arg: Any, place: Place) -> Step:
        size = lambda a: len(a.encode()) if isinstance(a, str) else 0
        return Compare(
            place.path, info, pairs_of(arg, place, lambda x: number_arg(x, place, "a length")),
            lambda a, r, d, f: size(a) <= r if largest else size(a) >= r,
            lambda a, r, d, f: F.octet_length(a.string_or_empty()) <= r if largest else F.octet_length(a.string_or_empty()) >= r,
            lambda x: format_float(x[0]),
        )

    return make


KEYWORDS["maxLengths"], KEYWORDS["minLengths"] = _length_compare("max length is ", True), _length_compare("min length is ", False)


def _template_text(right, doc: Val, flags: Flags) -> Column:
    return right.lower(doc, flags).string_of()


def _show_template(x: tuple) -> str:
    return string_of(x[0].get(x[1], x[2]))


def _order_compare(info: str, python: Callable[[float, float], bool]):
    def make(arg: Any, place: Place) -> Step:
        asserted = lambda x: float(x) if isinstance(x, (float, int)) and not isinstance(x, bool) else 0.0
        return Compare(
            place.path, info, pairs_of(arg, place, templates.parse),
            lambda a, r, d, f: python(asserted(a), asserted(r.get(d, f))),
            lambda a, r, d, f: python(a.number_or_zero(), r.lower(d, f).number_or_zero()),
            _show_template, show_column=_template_text,
        )

    return make


KEYWORDS["gt"] = _order_compare("should greater than ", lambda a, b: a > b)
KEYWORDS["lt"] = _order_compare("should less than", lambda a, b: a < b)
KEYWORDS["gte"] = _order_compare("should greater or equal than ", lambda a, b: a >= b)
KEYWORDS["lte"] = _order_compare("should less or equal  than ", lambda a, b: a <= b)


@keyword("neq")
def _neq(arg: Any, place: Place) -> Step:
    return Compare(
        place.path, "should not equal with ", pairs_of(arg, place, templates.parse),
        lambda a, r, d, f: not root_equal(a, r.get(d, f), f),
        lambda a, r, d, f: ~a.root_equal(r.lower(d, f), f),
        _show_template, show_column=_template_text,
    )


@keyword("eq", "equals", "keyMatch")
def _eq(arg: Any, place: Place) -> Step:
    def holds(a: Any, r: Any, d: Any, f: Flags) -> bool:
        want = r.get(d, f)
        if isinstance(want, str):
            return want == string_of(a)
        if isinstance(want, bool):
            return want == root_bool_of(a)
        return type(want) is type(a) and want == a if not isinstance(want, (dict, list)) else False

    def column(a: Val, r: Any, d: Val, f: Flags) -> Column:
        want = r.lower(d, f)
        same = F.when(want.is_string(), want.string() == _text_or_nothing(a)).when(want.is_bool(), want.boolean() == a.root_bool_of())
        return F.coalesce(same, want.number() == a.number(), want.is_nil() & a.is_nil())

    show = lambda x: print_value(x[0].get(x[1], x[2]))
    return Compare(place.path, "value must be ", pairs_of(arg, place, templates.parse), holds, column, show, True, _template_text)


def _text_or_nothing(v: Val) -> Column:
    return F.lit(None).cast("string") if v.kind in ("arr", "obj") else v.string_of()


def _in(arg: Any, place: Place) -> Compare:
    def right(v: Any) -> list:
        need(isinstance(v, list), place, "'in' needs an array on the right")
        return [templates.parse(x) for x in v]

    def column(a: Val, r: list, d: Val, f: Flags) -> Column:
        out = F.lit(False)
        texts = [x.value for x in r if isinstance(x, templates.Const) and isinstance(x.value, str)]
        if texts:
            out = out | a.string_of().isin(texts)
        for x in r:
            if not (isinstance(x, templates.Const) and isinstance(x.value, str)):
                out = out | F.coalesce(x.lower(d, f).root_equal(a, f), F.lit(False))
        return out

    return Compare(
        place.path, "should be one of  ", pairs_of(arg, place, right),
        lambda a, r, d, f: any(root_equal(x.get(d, f), a, f) for x in r), column,
        lambda x: print_value([v.value if isinstance(v, templates.Const) else string_of(v.get(x[1], x[2])) for v in x[0]]),
    )


KEYWORDS["in"] = _in
KEYWORDS["notin"] = lambda arg, place: Not(Schema(place.path, [("in", _in(arg, place))]), place.path)


def ip_number(text: str) -> int | None:
    try:
        return int(ipaddress.IPv4Address(text))
    except ValueError:
        return None


def ip_column(c: Column) -> Column:
    parts = F.split(c, r"\.")
    number = lambda k: F.get(parts, k).try_cast("bigint")
    return F.when(c.rlike(formats.IPV4), ((number(0) * 256 + number(1)) * 256 + number(2)) * 256 + number(3))


@keyword("ipIn")
def _ip_in(arg: Any, place: Place) -> Step:
    def ranges(v: Any) -> list[tuple[int, int]]:
        need(isinstance(v, list), place, "ipIn needs an array")
        out = []
        for x in map(string_of, v):
            try:
                net = ipaddress.IPv4Network(x if "/" in x else f"{x}/32", strict=False)
            except ValueError as e:
                raise SchemaError(f"{place.path}: {e}") from e
            out.append((int(net.network_address), int(net.broadcast_address), x))
        return out

    def holds(a: Any, r: list, d: Any, f: Flags) -> bool:
        ip = ip_number(a) if isinstance(a, str) else None
        return ip is not None and any(lo <= ip <= hi for lo, hi, _ in r)

    def column(a: Val, r: list, d: Val, f: Flags) -> Column:
        ip, out = ip_column(a.string()), F.lit(False)
        for lo, hi, _ in r:
            out = out | ip.between(lo, hi)
        return out

    return Compare(place.path, " ip should be within ", pairs_of(arg, place, ranges), holds, column, lambda x: print_value([t for _, _, t in x[0]]))


@dataclass
class Single(Check):
    """startWith, endWith and contains on the value itself."""

    path: str
    text: str
    info: str
    holds: Callable[[str, str], bool]
    column: Callable[[Column, str], Column]

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, str) and not self.holds(value, self.text):
            ctx.add(self.path, self.info + self.text)

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        errors.one(~self.column(value.string(), self.text), self.path, self.info + self.text)


for _name, _info, _holds, _column in (("startWith", " should start with ", str.startswith, lambda c, r: c.startswith(r)), ("endWith", " should end with ", str.endswith, lambda c, r: c.endswith(r)), ("contains", " should contains ", lambda a, r: r in a, lambda c, r: c.contains(r))):
    KEYWORDS[_name] = lambda arg, place, i=_info, h=_holds, c=_column: Single(place.path, string_of(arg), i, h, c)


def add_comparator(name: str, info: str, holds: Callable[[Any, Any], bool], column: Callable[[Val, Val], Column] | None = None) -> None:
    """Register a {path: template} comparison of a user's own."""

    def lowered(a: Val, r: Any, d: Val, f: Flags) -> Column:
        if column is None:
            raise NotLowerable(name)
        return column(a, r.lower(d, f))

    KEYWORDS[name] = lambda arg, place: Compare(place.path, info, pairs_of(arg, place, templates.parse), lambda a, r, d, f: holds(a, r.get(d, f)), lowered, _show_template, show_column=_template_text)


# ---- structure and logic ----------------------------------------------------------------


class Properties(Step):
    def __init__(self, place: Place, schemas: dict[str, Schema], extras: dict[str, dict[str, Step]], open_: bool, rest: Schema | None) -> None:
        self.path, self.schemas, self.extras, self.open, self.rest = place.path, schemas, extras, open_, rest
        self.writes = any(extras.values())

    def children(self) -> list[Schema]:
        return [*self.schemas.values(), *([self.rest] if self.rest else [])]

    def child(self, name: str) -> Schema | None:
        return self.schemas.get(name)

    def run(self, ctx: Context, value: Any) -> None:
        if not isinstance(value, dict):
            if value is not None:
                ctx.add(self.path, "type should be object")
            return
        for k in sorted(value):
            if k in self.schemas:
                self.schemas[k].run(ctx, value[k])
            elif not self.open:
                ctx.add(f"{self.path}.{k}", "unknown field")
            elif self.rest is not None:
                self.rest.run(ctx, value[k])
        for k, v in self.extras["constVal"].items():
            value[k] = copy.deepcopy(v.arg)
        for k, v in self.extras["defaultVal"].items():
            if k not in value:
                value[k] = copy.deepcopy(v.arg)
        for k, v in self.extras["replaceKey"].items():
            if k in value and v.arg not in value:
                value[v.arg] = value[k]
        for k, v in self.extras["formatVal"].items():
            if k in value:
                value[k] = convert(v.arg, value[k], ctx.flags)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        errors = Errors()
        is_object = value.is_object()
        errors.one(~is_object & ~value.is_nil(), self.path, "type should be object")
        changed: dict[str, Val] = {}
        names = [k for k in sorted(self.schemas) if (value.fields is None or k in value.fields) and self.schemas[k].tests]
        for k, before in zip(names, low.once([value.get(k) for k in names]), strict=True):
            have = before.col.isNotNull() if before.tag is not None else value.has(k)
            after, more = self.schemas[k].lower(low if self.schemas[k].any_writes else low.inner(), before)
            errors.take(more, is_object & have)
            if after is not before:
                changed[k] = after
        if not self.open:
            known = [F.lit(k) for k in self.schemas]
            if value.fields is not None:
                for k in sorted(set(value.fields) - set(self.schemas)):
                    errors.one(is_object, f"{self.path}.{k}", "unknown field")
            else:
                unknown = F.array_sort(F.array_except(value.keys(), F.array(*known) if known else F.array().cast("array<string>")))
                errors.many(F.when(is_object, F.transform(unknown, lambda k: F.struct(F.concat(F.lit(f"{self.path}."), k).alias("path"), F.lit("unknown field").alias("info")))))
        elif self.rest is not None:
            self._rest(low, value, errors, is_object)
        if not self.writes and not changed:
            return value, errors
        out = as_object(value)
        for k, v in changed.items():
            out = low.bind(with_key(out, k, v, out.has(k)))
        for k, v in self.extras["constVal"].items():
            out = low.bind(with_key(out, k, literal(v.arg)))
        for k, v in self.extras["defaultVal"].items():
            out = low.bind(with_key(out, k, literal(v.arg), ~out.has(k)))
        for k, v in self.extras["replaceKey"].items():
            out = low.bind(with_key(out, v.arg, out.get(k), out.has(k) & ~out.has(v.arg)))
        for k, v in self.extras["formatVal"].items():
            out = low.bind(with_key(out, k, convert_column(v.arg, out.get(k), low.flags), out.has(k)))
        return out, errors

    def _rest(self, low: Lowering, value: Val, errors: Errors, is_object: Column) -> None:
        if self.rest.any_writes:
            raise NotLowerable("writes in additional properties")
        if value.fields is not None:
            for k in sorted(set(value.fields) - set(self.schemas)):
                errors.take(self.rest.lower(low.inner(), value.get(k))[1], is_object)
            return
        known = list(self.schemas)
        entries = F.map_entries(F.map_filter(value.map(), lambda k, _: ~k.isin(known) if known else F.lit(True)))
        found = F.transform(F.array_sort(F.transform(entries, lambda e: e["key"])), lambda k: self.rest.lower(low.inner(), Val(F.try_element_at(value.map(), k), T.VariantType()))[1].array())
        errors.many(F.when(is_object, F.flatten(found)))


EXTRAS = {"constVal": "constVal", "defaultVal": "defaultVal", "default": "defaultVal", "replaceKey": "replaceKey", "formatVal": "formatVal"}


@keyword("properties", "props")
def _properties(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "properties must be an object")
    extra = place.raw.get("additionalProperties")
    rest = None
    if isinstance(extra, dict):
        rest = place.compiler.compile(extra, place.path + "{*}")
    schemas, extras = {}, {"constVal": {}, "defaultVal": {}, "replaceKey": {}, "formatVal": {}}
    for name, spec in arg.items():
        schemas[name] = place.compiler.compile(spec, f"{place.path}.{name}")
        for word, kind in EXTRAS.items():
            if isinstance(spec, dict) and word in spec:
                extras[kind][name] = schemas[name].get(word)
    return Properties(place, schemas, extras, extra is True or rest is not None, rest)


@keyword("additionalProperties")
def _additional(arg: Any, place: Place) -> Step:
    need(isinstance(arg, (bool, dict)), place, "additionalProperties must be a boolean or a schema")
    return Inert(arg)


for _name in ("constVal", "defaultVal", "default"):
    KEYWORDS[_name] = lambda arg, place: Inert(arg)


@keyword("replaceKey")
def _replace_key(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str), place, "replaceKey must be a string")
    return Inert(arg)


@keyword("formatVal")
def _format_val(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str), place, "formatVal must be a string")
    return Inert(arg)


def convert(name: str, value: Any, flags: Flags) -> Any:
    if name == "string":
        return string_of(value)
    if name in ("bool", "boolean"):
        return root_bool_of(value)
    if name in ("integer", "number"):
        return root_number_of(value, flags)
    if name == "lower":
        return string_of(value).lower()
    return string_of(value).upper() if name == "upper" else value


def convert_column(name: str, value: Val, flags: Flags) -> Val:
    if name in ("string", "lower", "upper"):
        text = value.string_of()
        return Val({"string": lambda c: c, "lower": F.lower, "upper": F.upper}[name](text), T.StringType(), True)
    if name in ("bool", "boolean"):
        return Val(value.root_bool_of(), T.BooleanType(), True)
    if name in ("integer", "number"):
        return Val(value.root_number_of(flags), T.DoubleType(), True)
    return value


class ItemsOf(Step):
    def __init__(self, schema: Schema) -> None:
        self.schema = schema

    def children(self) -> list[Schema]:
        return [self.schema]

    def child(self, name: str) -> Step | None:
        return self.schema.child(name)

    def run(self, ctx: Context, value: Any) -> None:
        for x in value if isinstance(value, list) else ():
            self.schema.run(ctx, x)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        if self.schema.any_writes:
            raise NotLowerable("writes in items")
        errors = Errors()
        if value.kind in ("arr", "any"):
            errors.many(F.flatten(value.each(lambda x: self.schema.lower(low.inner(), x)[1].array())))
        return value, errors


@keyword("items")
def _items(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "items must be an object")
    return ItemsOf(place.compiler.compile(arg, place.path + "[*]"))


class Children(Step):
    """Like properties, for the keys there are, and never closed."""

    def __init__(self, schemas: dict[str, Schema]) -> None:
        self.schemas = schemas

    def children(self) -> list[Schema]:
        return list(self.schemas.values())

    def child(self, name: str) -> Schema | None:
        return self.schemas.get(name)

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, dict):
            for k, s in self.schemas.items():
                if k in value:
                    s.run(ctx, value[k])

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        errors, out = Errors(), value
        names = [k for k, s in self.schemas.items() if s.tests]
        first = dict(zip(names, low.once([value.get(k) for k in names]), strict=True))
        for k, s in self.schemas.items():
            if not s.tests:
                continue
            have = value.is_object() & value.has(k)
            before = first[k] if out is value else out.get(k)
            after, more = s.lower(low if s.any_writes else low.inner(), before)
            errors.take(more, have)
            if after is not before:
                out = as_object(out)
                out = low.bind(with_key(out, k, after, out.has(k)))
        return out, errors


@keyword("children")
def _children(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "children must be an object")
    return Children({k: place.compiler.compile(v, f"{place.path}.{k}") for k, v in arg.items()})


class AllOf(Schema):
    def children(self) -> list[Schema]:
        return [s for _, s in self.steps]


@keyword("allOf", "and")
def make_all_of(arg: Any, place: Place) -> Step:
    need(isinstance(arg, list), place, "allOf must be an array")
    return AllOf(place.path, [(str(k), place.compiler.compile(s, place.path, place.in_if)) for k, s in enumerate(arg)])


class AnyOf(Step):
    """The first branch without errors wins; else all errors. Writes of failed branches are dropped."""

    def __init__(self, branches: list[Schema], path: str, exactly_one: bool = False) -> None:
        self.branches, self.path, self.exactly_one = branches, path, exactly_one

    def children(self) -> list[Schema]:
        return self.branches

    def run(self, ctx: Context, value: Any) -> None:
        errors, good = [], 0
        for b in self.branches:
            fork = ctx.fork()
            trial = copy.deepcopy(value) if b.any_writes and not ctx.flags.strict else value
            b.run(fork, trial)
            if not fork.errors:
                good += 1
                if b.any_writes and trial is not value:
                    _overwrite(value, trial)
                if not self.exactly_one:
                    return
            errors += fork.errors
        if self.exactly_one and good:
            if good > 1:
                ctx.add(self.path, "more than one branch is valid")
            return
        ctx.errors += errors

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        if any(b.any_writes for b in self.branches):
            raise NotLowerable("writes in anyOf")
        found = [b.lower(low.inner(), value)[1] for b in self.branches]
        oks = [e.ok() for e in found]
        none = ~oks[0]
        for ok in oks[1:]:
            none = none & ~ok
        errors = Errors()
        for e in found:
            errors.take(e, none)
        if self.exactly_one:
            count = sum((ok.cast("int") for ok in oks[1:]), oks[0].cast("int"))
            errors.one(count > 1, self.path, "more than one branch is valid")
        return value, errors


def _overwrite(target: Any, source: Any) -> None:
    if isinstance(target, dict) and isinstance(source, dict):
        target.clear()
        target.update(source)
    elif isinstance(target, list) and isinstance(source, list):
        target[:] = source


def _branches(arg: Any, place: Place) -> list[Schema]:
    need(isinstance(arg, list), place, "an array of schemas is needed")
    return [place.compiler.compile(s, place.path, place.in_if) for s in arg]


@keyword("anyOf", "or")
def _any_of(arg: Any, place: Place) -> Step:
    return AnyOf(_branches(arg, place), place.path)


@keyword("oneOf")
def _one_of(arg: Any, place: Place) -> Step:
    need(bool(arg), place, "oneOf must not be empty")
    return AnyOf(_branches(arg, place), place.path)


@keyword("exactlyOneOf")
def _exactly_one_of(arg: Any, place: Place) -> Step:
    need(bool(arg), place, "exactlyOneOf must not be empty")
    return AnyOf(_branches(arg, place), place.path, True)


class Not(Step):
    def __init__(self, schema: Schema, path: str = "") -> None:
        self.schema, self.path = schema, path

    def children(self) -> list[Schema]:
        return [self.schema]

    def run(self, ctx: Context, value: Any) -> None:
        fork = ctx.fork()
        self.schema.run(fork, value)
        if not fork.errors:
            ctx.add(self.path, "is not valid")

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        value, inner = self.schema.lower(low, value)
        errors = Errors()
        errors.one(inner.ok(), self.path, "is not valid")
        return value, errors


@keyword("not")
def _not(arg: Any, place: Place) -> Step:
    return Not(place.compiler.compile(arg, place.path, place.in_if))


def merged(low: Lowering, when: Column, yes: Val, no: Val) -> Val:
    """One value of two branches."""
    if yes is no:
        return yes
    yes, no = as_object(yes), as_object(no)
    return low.bind(Val(F.when(when, yes.col).otherwise(no.col), yes.dtype, origin=yes.origin))


class If(Step):
    def __init__(self, test: Schema, then: Schema | None, other: Schema | None) -> None:
        self.test, self.then, self.other = test, then, other

    def children(self) -> list[Schema]:
        return [s for s in (self.test, self.then, self.other) if s]

    def run(self, ctx: Context, value: Any) -> None:
        fork = ctx.fork()
        self.test.run(fork, value)
        branch = self.other if fork.errors else self.then
        if branch:
            branch.run(ctx, value)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        value, tested = self.test.lower(low, value)
        ok, errors = tested.ok(), Errors()
        ends = []
        for branch, when in ((self.then, ok), (self.other, ~ok)):
            end = value
            if branch:
                end, more = branch.lower(low, value)
                errors.take(more, when)
            ends.append(end)
        return merged(low, ok, *ends), errors


@keyword("if")
def _if(arg: Any, place: Place) -> Step:
    branch = lambda k: s.arg if isinstance(s := place.siblings.get(k), Inert) else None
    return If(place.compiler.compile(arg, place.path, True), branch("then"), branch("else"))


@keyword("then", "else")
def _branch(arg: Any, place: Place) -> Step:
    schema = place.compiler.compile(arg, place.path)
    return Inert(schema, {"": schema})


class Switch(Step):
    def __init__(self, name: str, cases: dict[str, Schema], other: Schema | None) -> None:
        self.name, self.cases, self.other = name, cases, other

    def children(self) -> list[Schema]:
        return [*self.cases.values(), *([self.other] if self.other else [])]

    def run(self, ctx: Context, value: Any) -> None:
        branch = self.other
        if isinstance(value, dict):
            branch = self.cases.get(string_of(value.get(self.name)), self.other)
        if branch:
            branch.run(ctx, value)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        errors, out = Errors(), value
        chosen = value.get(self.name).string_of()
        left = F.lit(True)
        for text, schema in self.cases.items():
            when = value.is_object() & (chosen == text)
            end, more = schema.lower(low, value)
            errors.take(more, when)
            out = merged(low, when, end, out)
            left = left & ~when
        if self.other:
            end, more = self.other.lower(low, value)
            errors.take(more, left)
            out = merged(low, left, end, out)
        return out, errors


@keyword("switch")
def _switch(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str), place, "switch must be a string")
    cases, other = place.siblings.get("case"), place.siblings.get("defaults")
    return Switch(arg, cases.schemas if isinstance(cases, Inert) else {}, other.arg if isinstance(other, Inert) else None)


@keyword("case")
def _case(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "case must be an object")
    return Inert(None, {k: place.compiler.compile(v, place.path) for k, v in arg.items()})


@keyword("defaults")
def _defaults(arg: Any, place: Place) -> Step:
    return Inert(place.compiler.compile(arg, place.path))


class Foreach(Step):
    """Binds __key and __val in the document for each element and runs a schema on the document."""

    writes = True

    def __init__(self, loops: list[tuple[Any, Schema]]) -> None:
        self.loops = loops

    def children(self) -> list[Schema]:
        return [s for _, s in self.loops]

    def run(self, ctx: Context, value: Any) -> None:
        if not isinstance(value, dict):
            return
        for p, schema in self.loops:
            found = p.get(value)
            if isinstance(found, list):
                pairs = [(float(k), v) for k, v in enumerate(found)]
            elif isinstance(found, dict):
                pairs = sorted(found.items())
            else:
                pairs = []
            for k, v in pairs:
                value["__key"], value["__val"] = k, v
                schema.run(ctx, value)
            value.pop("__key", None)
            value.pop("__val", None)


@keyword("foreach")
def _foreach(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "foreach must be an object")
    return Foreach([(parse_path(k), place.compiler.compile(v, f"{place.path}.{k}")) for k, v in arg.items()])


@keyword("$defs", "definitions")
def _defs(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "$defs must be an object")
    return Inert(None, {k: place.compiler.compile(v, "$") for k, v in arg.items()})


class Ref(Step):
    """A reference by path through the schema; recursive ones are unrolled to a depth, then interpreted."""

    def __init__(self, text: str, path: str, owner: Schema) -> None:
        self.names, self.path, self.owner = [x for x in text.removeprefix("#").removeprefix("/").split("/") if x], path, owner

    def target(self, root: Any) -> Step | None:
        node = root
        for name in self.names:
            node = node.child(name) if node is not None else None
        return node

    def run(self, ctx: Context, value: Any) -> None:
        node = self.target(ctx.root)
        if node is self or (node is self.owner and self.owner is not ctx.root):
            return ctx.add(self.path, "self reference of $ref")
        if node is None or value is None and node is ctx.root:
            return None
        fork = ctx.fork()
        node.run(fork, value)
        ctx.errors += [(self.path + p[1:] if p else p, info) for p, info in fork.errors]
        return None

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        node = self.target(low.root)
        if node is None:
            return value, Errors()
        if node is self or node is self.owner:
            errors = Errors()
            errors.one(F.lit(True), self.path, "self reference of $ref")
            return value, errors
        out, inner = node.lower(low.deeper(), value)
        errors = Errors()
        for part in inner.parts:
            if isinstance(part, tuple):
                bad, path, info = part
                errors.one(bad, self.path + path[1:] if isinstance(path, str) else F.concat(F.lit(self.path), F.substring(path, 2, 1 << 20)), info)
            else:
                errors.many(F.transform(part, lambda e: F.struct(F.concat(F.lit(self.path), F.substring(e["path"], 2, 1 << 20)).alias("path"), e["info"].alias("info"))))
        return out, errors


@keyword("$ref")
def _ref(arg: Any, place: Place) -> Step:
    need(isinstance(arg, str), place, "$ref must be a string")
    return Ref(arg, place.path, place.siblings)


@dataclass
class ErrorStep(Check):
    path: str
    template: Any

    def run(self, ctx: Context, value: Any) -> None:
        ctx.add(self.path, string_of(self.template.get(value, ctx.flags)))

    def test(self, low: Lowering, value: Val, errors: Errors) -> None:
        errors.one(F.lit(True), self.path, self.template.lower(value, low.flags).string_of())


@keyword("error")
def _error(arg: Any, place: Place) -> Step:
    return ErrorStep(place.path, templates.parse(arg))


# ---- writes -----------------------------------------------------------------------------


class Write(Step):
    writes = True


class DefaultVals(Write):
    def __init__(self, values: dict) -> None:
        self.values_ = values

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, dict):
            for k, v in self.values_.items():
                if k not in value:
                    value[k] = copy.deepcopy(v)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        out = low.written(value) if self.values_ else as_object(value)
        for k, v in self.values_.items():
            out = low.bind(with_key(out, k, literal(v), ~out.has(k)))
        return out, Errors()


@keyword("defaultVals")
def _default_vals(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "defaultVals must be an object")
    return DefaultVals(arg)


def set_column(low: Lowering, value: Val, steps: tuple, new: Val) -> Val:
    """The object with a path of plain keys written."""
    if not steps or any(not isinstance(s, Key) for s in steps):
        raise NotLowerable("a write to an index")
    out = as_object(value)
    name = steps[0].name
    if len(steps) == 1:
        return with_key(out, name, new)
    inner = as_object(out.get(name))
    inner = Val(F.coalesce(inner.col, F.create_map().cast("map<string,variant>")), inner.dtype)
    return with_key(out, name, set_column(low, inner, steps[1:], new))


class SetVal(Write):
    def __init__(self, pairs: list, skip_nil: bool) -> None:
        self.pairs, self.skip_nil = pairs, skip_nil

    def run(self, ctx: Context, value: Any) -> None:
        for p, t in self.pairs:
            new = t.get(value, ctx.flags)
            if not (self.skip_nil and new is None) and isinstance(value, (dict, list)):
                p.set(value, new)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        out = low.written(value) if self.pairs else as_object(value)
        for p, t in self.pairs:
            new = t.lower(out, low.flags)
            after = set_column(low, out, p.steps, new)
            if self.skip_nil:
                after = Val(F.when(new.is_nil(), out.col).otherwise(after.col), out.dtype, origin=out.origin)
            out = low.bind(after)
        return out, Errors()


@keyword("set", "setVal")
def _set_val(arg: Any, place: Place) -> Step:
    return SetVal(pairs_of(arg, place, templates.parse), False)


@keyword("setNN")
def _set_nn(arg: Any, place: Place) -> Step:
    return SetVal(pairs_of(arg, place, templates.parse), True)


class SetExpr(Write):
    """{key template: value template} on the document's own keys."""

    def __init__(self, pairs: list) -> None:
        self.pairs = pairs

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, dict):
            for k, t in self.pairs:
                new = t.get(value, ctx.flags)
                value[string_of(k.get(value, ctx.flags))] = new

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        out = low.written(value) if self.pairs else as_object(value)
        for k, t in self.pairs:
            out = low.bind(with_key(out, k.lower(out, low.flags).string_of(), t.lower(out, low.flags)))
        return out, Errors()


@keyword("setExpr")
def _set_expr(arg: Any, place: Place) -> Step:
    need(isinstance(arg, dict), place, "setExpr must be an object")
    return SetExpr([(templates.parse(k), templates.parse(v)) for k, v in arg.items()])


class MapWrite(Write):
    """setMap, delMap and del: {target: {key template: value template}} or {key template: ...} on objects of the document."""

    def __init__(self, pairs: list, delete: bool) -> None:
        self.pairs, self.delete = pairs, delete

    def run(self, ctx: Context, value: Any) -> None:
        if not isinstance(value, dict):
            return
        for k, t in self.pairs:
            key = string_of(k.get(value, ctx.flags))
            if self.delete:
                value.pop(key, None)
            else:
                value[key] = t.get(value, ctx.flags)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        out = low.written(value) if self.pairs else as_object(value)
        for k, t in self.pairs:
            key = k.lower(out, low.flags).string_of()
            out = low.bind(without_keys(out, [key]) if self.delete else with_key(out, key, t.lower(out, low.flags)))
        return out, Errors()


def _map_write(delete: bool):
    def make(arg: Any, place: Place) -> Step:
        need(isinstance(arg, dict), place, "an object is needed")
        if set(arg) <= {"key", "val"} and "key" in arg:
            return MapWrite([(templates.parse(arg["key"]), templates.parse(arg.get("val")))], delete)
        return MapWrite([(templates.parse(k), templates.parse(v)) for k, v in arg.items()], delete)

    return make


KEYWORDS["setMap"], KEYWORDS["delMap"], KEYWORDS["del"] = _map_write(False), _map_write(True), _map_write(True)


class Delete(Write):
    def __init__(self, names: list[str]) -> None:
        self.names = names

    def run(self, ctx: Context, value: Any) -> None:
        if isinstance(value, dict):
            for n in self.names:
                value.pop(n, None)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        return low.bind(without_keys(as_object(value), self.names)), Errors()


@keyword("delete")
def _delete(arg: Any, place: Place) -> Step:
    return Delete(string_list(arg, place, "delete"))


class CallStep(Write):
    """A template evaluated for what it does to the document."""

    def __init__(self, template: Any) -> None:
        self.template = template

    def run(self, ctx: Context, value: Any) -> None:
        self.template.get(value, ctx.flags)

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        t = self.template
        if isinstance(t, templates.Call) and t.name in ("delete", "map.del"):
            return low.bind(without_keys(as_object(value), [a.lower(value, low.flags).string_of() for a in t.args])), Errors()
        raise NotLowerable("call")


@keyword("call")
def _call(arg: Any, place: Place) -> Step:
    return CallStep(templates.parse(arg))


#: Methods and functions that write into the values they are called on.
MUTATING = {"set", "delete", "merge", "sort", "set_index", "append"}


def _calls(node: Any) -> set[str]:
    found = {node.name} if isinstance(node, (Call, Method)) else set()
    for value in vars(node).values() if isinstance(node, Node) else ():
        for item in value if isinstance(value, tuple) else (value,):
            for part in item if isinstance(item, tuple) else (item,):
                if isinstance(part, Node):
                    found |= _calls(part)
    return found


class Script(Step):
    """A rule program with the document bound to `$`; a value it returns is an error."""

    def __init__(self, program: Any, path: str) -> None:
        self.program, self.path = program, path
        self.writes = "$" in assigned(program) or bool(_calls(program) & MUTATING)

    def run(self, ctx: Context, value: Any) -> None:
        machine = Machine({"$": value}, ctx.flags)
        machine.run(self.program)
        if machine.returned:
            ctx.add(self.path, f"err :{print_value(machine.returned)}")

    def lower(self, low: Lowering, value: Val) -> tuple[Val, Errors]:
        if self.writes:
            raise NotLowerable("a script that writes into the document")
        machine = Lowerer({"$": value}, low.flags)
        machine.value(self.program)
        if machine.ragged:
            raise NotLowerable("returns of different lengths")
        errors = Errors()
        if machine.returned:
            said = [F.when(v.is_nil(), "<nil>").otherwise(v.string_of()) for v in machine.returned]
            errors.one(machine.done, self.path, F.concat(F.lit("err :["), F.concat_ws(" ", *said), F.lit("]")))
        return value, errors


@keyword("script")
def _script(arg: Any, place: Place) -> Step:
    try:
        return Script(parse_program(arg), place.path)
    except RuleError as e:
        raise SchemaError(f"{place.path}: {e}") from e


def compile_schema(spec: Any, flags: Flags = Flags(), ignored: set[str] | None = None) -> Schema:
    """The compiled schema; a reference that leads nowhere does not compile."""
    schema = Compiler(flags, ignored).compile(plain(spec))

    def refs(step: Any):
        if isinstance(step, Ref):
            yield step
        for _, s in getattr(step, "steps", ()):
            yield from refs(s)
        for s in step.children() if not isinstance(step, Schema) else ():
            yield from refs(s)
        for s in getattr(step, "schemas", {}).values():
            yield from refs(s)

    if not flags.strict:
        for r in refs(schema):
            if r.target(schema) is None:
                raise SchemaError(f"{r.path}: $ref leads nowhere")
    return schema


#: The rule functions, which scripts need where they run.
RULE_FUNCTIONS = rules.FUNCTIONS

__all__ = ["Check", "Compiler", "Context", "ERROR", "Errors", "Index", "KEYWORDS", "Lowering", "Place", "Schema", "SchemaError", "Step", "add_comparator", "compile_schema", "ignore_keywords", "register_validator"]
