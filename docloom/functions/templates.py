"""The template value language: "${a.b[0]}_x" and ["fn()", arg, ...] inside schemas.

A template is compiled once. `get` evaluates it on a document in Python, `lower` makes a
`Val` of it. Functions are registered with a Python form and, where one exists, a Column form.
"""

from __future__ import annotations

import hashlib
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import gotime
from docloom.functions.values import ABSENT, Flags, dump_json, parse_json, print_value, root_bool_of, root_number_of, string_of
from docloom.plans.columns import NotLowerable, Val, constant_of, literal
from docloom.plans.paths import Path, parse_path


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any

    def get(self, doc: Any, flags: Flags = Flags()) -> Any:
        return self.value

    def lower(self, doc: Val, flags: Flags = Flags()) -> Val:
        return literal(self.value)


@dataclass(frozen=True)
class Var:
    path: Path

    def get(self, doc: Any, flags: Flags = Flags()) -> Any:
        found = self.path.get(doc)
        return None if found is ABSENT else found

    def lower(self, doc: Val, flags: Flags = Flags()) -> Val:
        return doc.path(self.path)


@dataclass(frozen=True)
class Combo:
    parts: tuple

    def get(self, doc: Any, flags: Flags = Flags()) -> Any:
        return "".join(string_of(p.get(doc, flags)) for p in self.parts)

    def lower(self, doc: Val, flags: Flags = Flags()) -> Val:
        return Val(F.concat(*(p.lower(doc, flags).string_of() for p in self.parts)), T.StringType(), True)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    def get(self, doc: Any, flags: Flags = Flags()) -> Any:
        return FUNCTIONS[self.name].run(doc, flags, *(a.get(doc, flags) for a in self.args))

    def lower(self, doc: Val, flags: Flags = Flags()) -> Val:
        function = FUNCTIONS[self.name]
        if function.column is None:
            raise NotLowerable(f"template function {self.name}")
        return function.column(flags, *(a.lower(doc, flags) for a in self.args))


@dataclass(frozen=True)
class Object:
    items: tuple[tuple[str, Any], ...]

    def get(self, doc: Any, flags: Flags = Flags()) -> Any:
        return {k: v.get(doc, flags) for k, v in self.items}

    def lower(self, doc: Val, flags: Flags = Flags()) -> Val:
        if not self.items:
            return literal({})
        pairs = [x for k, v in self.items for x in (F.lit(k), v.lower(doc, flags).variant())]
        return Val(F.to_variant_object(F.create_map(*pairs)), T.VariantType(), True)


@dataclass(frozen=True)
class Array:
    items: tuple

    def get(self, doc: Any, flags: Flags = Flags()) -> Any:
        return [v.get(doc, flags) for v in self.items]

    def lower(self, doc: Val, flags: Flags = Flags()) -> Val:
        if not self.items:
            return literal([])
        return Val(F.to_variant_object(F.array(*(v.lower(doc, flags).variant() for v in self.items))), T.VariantType(), True)


def parse(value: Any):
    if isinstance(value, dict):
        return Object(tuple((k, parse(v)) for k, v in value.items()))
    if isinstance(value, str):
        if value.endswith("()"):
            return _call(value[:-2], [])
        return _interpolation(value) if "${" in value and "}" in value else Const(value)
    if isinstance(value, list):
        head = string_of(value[0]) if value and not isinstance(value[0], (dict, list)) else ""
        if head.endswith("()"):
            return _call(head[:-2], value[1:])
        return Array(tuple(map(parse, value)))
    return Const(value)


def _call(name: str, args: list) -> Call:
    if name not in FUNCTIONS:
        raise TemplateError(f"invalid function {name!r}")
    return Call(name, tuple(map(parse, args)))


def _interpolation(text: str):
    parts, at = [], 0
    while True:
        start = text.find("${", at)
        end = text.find("}", start) if start >= 0 else -1
        if start < 0 or end < 0:
            break
        if start > at:
            parts.append(Const(text[at:start]))
        name = text[start + 2 : end]
        parts.append(_call(name[:-2], []) if name.endswith("()") else Var(parse_path(name)))
        at = end + 1
    if at < len(text):
        parts.append(Const(text[at:]))
    return parts[0] if len(parts) == 1 else Combo(tuple(parts))


@dataclass
class Function:
    run: Callable
    column: Callable | None = None


FUNCTIONS: dict[str, Function] = {}


def add_function(name: str, run: Callable, column: Callable | None = None) -> None:
    """Register run(doc, flags, *args) and, if there is one, column(flags, *vals) -> Val."""
    FUNCTIONS[name] = Function(run, column)


def _text(c) -> Val:
    return Val(c, T.StringType(), True)


def _number(c) -> Val:
    return Val(c, T.DoubleType(), True)


def _s(value: Any) -> str:
    return value if isinstance(value, str) else ""


def _quote(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def sprintf(text: str, *args: Any) -> str:
    """Format verbs v s d f t q x, with flags, width and precision."""
    import re

    rest = list(args)

    def one(m: re.Match) -> str:
        flag, verb = m.group(1), m.group(2)
        if verb == "%":
            return "%"
        if not rest:
            return f"%!{verb}(MISSING)"
        x = rest.pop(0)
        if verb == "d":
            return ("%" + flag + "d") % int(root_number_of(x)) if isinstance(x, (int, float)) else f"%!d({type(x).__name__}={print_value(x)})"
        if verb in "feg":
            return ("%" + flag + verb) % float(x) if isinstance(x, (int, float)) else f"%!{verb}({print_value(x)})"
        if verb == "t":
            return "true" if x is True else "false"
        if verb == "q":
            return _quote(string_of(x))
        if verb in "xX":
            out = string_of(x).encode().hex() if isinstance(x, (str, bytes)) else format(int(root_number_of(x)), "x")
            return out.upper() if verb == "X" else out
        return ("%" + flag.replace("+", "").replace("#", "") + "s") % print_value(x)

    return re.sub(r"%([-+# 0]*\d*(?:\.\d+)?)([a-zA-Z%])", one, text)


def _printf_column(flags: Flags, *args: Val) -> Val:
    raise NotLowerable("format verbs")


def _affix(where: str) -> Callable:
    def column(flags: Flags, s: Val, x: Val) -> Val:
        s, x = s.string_or_empty(), x.string_or_empty()
        if where == "prefix":
            return _text(F.when(s.startswith(x), F.substring(s, F.length(x) + 1, F.length(s))).otherwise(s))
        return _text(F.when(s.endswith(x), F.substring(s, F.lit(1), F.length(s) - F.length(x))).otherwise(s))

    return column


def _split_column(flags: Flags, s: Val, sep: Val) -> Val:
    return Val(F.split(s.string_or_empty(), F.concat(F.lit(r"\Q"), sep.string_or_empty(), F.lit(r"\E")), -1), T.ArrayType(T.StringType()), True)


def _or_column(flags: Flags, *args: Val) -> Val:
    kinds = {a.kind for a in args if a.kind != "null"}
    if len(kinds) == 1 and (kind := kinds.pop()) in ("str", "num", "bool"):
        dtype = {"str": T.StringType(), "num": T.DoubleType(), "bool": T.BooleanType()}[kind]
        return Val(F.coalesce(*(F.nullif(a.col.cast("string"), F.lit("")) if kind == "str" else a.col.cast(dtype) for a in args if a.kind != "null")), dtype)
    return Val(F.coalesce(*(F.when(~a.is_nil() & ~F.coalesce(a.string() == "", F.lit(False)), a.variant()) for a in args)), T.VariantType())


def _hash_of(name: str) -> Function:
    def column(flags: Flags, *args: Val) -> Val:
        joined = F.concat(*(a.string_of() for a in args)) if args else F.lit("")
        return _text(F.md5(joined.cast("binary")) if name == "md5" else F.sha2(joined.cast("binary"), 256))

    return Function(lambda doc, flags, *a: hashlib.new(name, "".join(map(string_of, a)).encode()).hexdigest(), column)


def _delete(doc: Any, flags: Flags, *keys: Any) -> None:
    if isinstance(doc, dict):
        for k in keys:
            doc.pop(string_of(k), None)


def _map_set(doc: Any, flags: Flags, target: Any, key: Any, value: Any) -> None:
    if isinstance(target, dict):
        target[string_of(key)] = value


def _arith(op: Callable[[float, float], float]) -> Callable:
    def run(doc: Any, flags: Flags, *args: Any) -> float:
        if len(args) < 2 or (flags.strict and len(args) <= 2):
            return 0.0
        out = root_number_of(args[0], flags)
        for a in args[1:]:
            out = op(out, root_number_of(a, flags))
        return out

    return run


def ieee_div(a: float, b: float) -> float:
    if b:
        return a / b
    return float("nan") if a == 0 or a != a else float("inf") if (a > 0) == (str(b)[0] != "-") else float("-inf")


def div_column(a, b):
    """IEEE division, which ANSI mode would raise on."""
    zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _reduce_column(op: Callable, first: bool = True) -> Callable:
    def column(flags: Flags, *args: Val) -> Val:
        if first and (len(args) < 2 or (flags.strict and len(args) <= 2)):
            return literal(0.0)
        out = args[0].root_number_of(flags)
        for a in args[1:]:
            out = op(out, a.root_number_of(flags))
        return _number(out)

    return column


def _total(op: Callable, start: float) -> Callable:
    def run(doc: Any, flags: Flags, *args: Any) -> float:
        out = start
        for a in args:
            out = op(out, root_number_of(a, flags))
        return out

    return run


def _json_from(doc: Any, flags: Flags, text: Any = None) -> Any:
    try:
        return parse_json(string_of(text))
    except ValueError:
        return None


def _fmod(a: float, b: float) -> float:
    import math

    return math.fmod(int(a), int(b)) if int(b) else float("nan")


def _mod_column(a, b):
    return F.when(b.cast("bigint") != 0, (a.cast("bigint") % F.when(b.cast("bigint") != 0, b.cast("bigint"))).cast("double")).otherwise(float("nan"))


FUNCTIONS |= {
    "append": Function(lambda d, f, *a: "".join(map(string_of, a)), lambda f, *a: _text(F.concat(*(x.string_of() for x in a)))),
    "add": Function(_total(lambda x, y: x + y, 0.0), _reduce_column(lambda x, y: x + y, False)),
    "mul": Function(_total(lambda x, y: x * y, 1.0), _reduce_column(lambda x, y: x * y, False)),
    "sub": Function(_arith(lambda x, y: x - y), _reduce_column(lambda x, y: x - y)),
    "div": Function(_arith(ieee_div), _reduce_column(div_column)),
    "mod": Function(_arith(_fmod), _reduce_column(_mod_column)),
    "str.split": Function(lambda d, f, s="", sep="", *n: (_s(s).split(_s(sep)) if _s(sep) else list(_s(s))), _split_column),
    "str.join": Function(lambda d, f, a=None, sep="": _s(sep).join(map(string_of, a)) if isinstance(a, list) else "", lambda f, a, sep: _text(F.coalesce(F.array_join(a.each(lambda x: x.string_of()), _constant(sep)), F.lit("")))),
    "str.trimPrefix": Function(lambda d, f, s="", x="": _s(s).removeprefix(_s(x)), _affix("prefix")),
    "str.trimSuffix": Function(lambda d, f, s="", x="": _s(s).removesuffix(_s(x)), _affix("suffix")),
    "str.trim": Function(lambda d, f, s="", cut="": _s(s).strip(_s(cut)) if _s(cut) else _s(s), lambda f, s, cut: _text(F.trim(s.string_or_empty(), cut.string_or_empty()))),
    "str.replace": Function(lambda d, f, s="", a="", b="": _s(s).replace(_s(a), _s(b)), lambda f, s, a, b: _text(F.replace(s.string_or_empty(), a.string_or_empty(), b.string_or_empty()))),
    "str.toLower": Function(lambda d, f, s="": _s(s).lower(), lambda f, s: _text(F.lower(s.string_or_empty()))),
    "str.toUpper": Function(lambda d, f, s="": _s(s).upper(), lambda f, s: _text(F.upper(s.string_or_empty()))),
    "str.quote": Function(lambda d, f, s="": _quote(_s(s))),
    "sprintf": Function(lambda d, f, text="", *a: sprintf(string_of(text), *a), _printf_column),
    "or": Function(lambda d, f, *a: next((x for x in a if x is not None and x != ""), None), _or_column),
    "delete": Function(_delete),
    "map.del": Function(_delete),
    "map.get": Function(lambda d, f, m=None, k="": m.get(string_of(k)) if isinstance(m, dict) else None, lambda f, m, k: m.get(_constant(k))),
    "map.set": Function(_map_set),
    "md5.hex": _hash_of("md5"),
    "sha256.hex": _hash_of("sha256"),
    "time.now": Function(lambda d, f: float(int(time.time())), lambda f: _number(F.unix_timestamp().cast("double"))),
    "time.format": Function(lambda d, f, t=None, layout="": gotime.format_time(t, _s(layout))),
    "json.to": Function(lambda d, f, v=None: dump_json(v), lambda f, v: _text(F.to_json(v.variant()))),
    "json.from": Function(_json_from, lambda f, v: Val(F.try_parse_json(v.string_of()), T.VariantType())),
    "new": Function(lambda d, f: {}, lambda f: literal({})),
    "tostring": Function(lambda d, f, v=None: string_of(v), lambda f, v: _text(v.string_of())),
    "tonumber": Function(lambda d, f, v=None: root_number_of(v, f), lambda f, v: _number(v.root_number_of(f))),
    "toint": Function(lambda d, f, v=None: float(int(root_number_of(v, f))), lambda f, v: _number(v.root_number_of(f).cast("bigint").cast("double"))),
    "tobool": Function(lambda d, f, v=None: root_bool_of(v), lambda f, v: Val(v.root_bool_of(), T.BooleanType(), True)),
    "rand.new16": Function(lambda d, f: secrets.token_hex(16)),
    "rand.new32": Function(lambda d, f: secrets.token_hex(32)),
}


def _constant(value: Val) -> str:
    """A separator or key must be a constant to be lowered."""
    return string_of(constant_of(value))
