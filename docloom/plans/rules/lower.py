"""Rule programs as Spark Columns.

Variables are single-assignment names of `Val`s; branches merge by CASE, loops over arrays
are `aggregate` with the assigned variables as state, lambdas are inlined. Kinds are inferred
while the plan is made. What cannot be lowered raises NotLowerable and is interpreted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import gotime
from docloom.functions.templates import div_column
from docloom.functions.values import ABSENT, Flags, string_of
from docloom.plans.columns import NotLowerable, Val, constant_of, let, literal
from docloom.plans.rules import parser as p

STR, NUM, BOOL, BIN, TIME = T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType(), T.TimestampType()


def text(c: Column) -> Val:
    return Val(c, STR, True)


def num(c: Column) -> Val:
    return Val(c, NUM, True)


def boolean(c: Column) -> Val:
    return Val(F.coalesce(c, F.lit(False)), BOOL, True)


def binary(c: Column) -> Val:
    return Val(c, BIN, True)


def nil() -> Val:
    return Val(F.lit(None).cast("variant"), None, const=None)


def as_double(v: Val) -> Column:
    return v.number_or_zero()


def as_long(v: Val) -> Column:
    x = v.rule_number_of()
    return F.coalesce(x.try_cast("bigint"), F.when(x > 0, (1 << 63) - 1).otherwise(-(1 << 63)))


def merge(test: Column, yes: Val, no: Val) -> Val:
    """One value of two branches, of their common kind or VARIANT."""
    if yes.kind == no.kind and yes.kind != "null":
        if yes.dtype == no.dtype:
            return Val(F.when(test, yes.col).otherwise(no.col), yes.dtype, yes.never_null and no.never_null)
        if yes.kind == "num":
            return Val(F.when(test, yes.col.cast("double")).otherwise(no.col.cast("double")), NUM, yes.never_null and no.never_null)
    if yes.kind == "null" and no.kind == "null":
        return nil()
    for a, b, when in ((yes, no, test), (no, yes, ~test)):
        if b.kind == "null" and a.kind != "any":
            return Val(F.when(when, a.col), a.dtype)
    side = lambda v: F.lit(None).cast("variant") if v.kind == "null" else F.when(~v.is_nil(), v.variant())
    return Val(F.when(test, side(yes)).otherwise(side(no)), T.VariantType())


def _or_else(a: Val, b: Val) -> Val:
    """The first, or the second where it is nil."""
    if a.never_null:
        return a
    if a.dtype == b.dtype and a.kind not in ("null", "any") and a.origin is None and b.origin is None:
        return Val(F.coalesce(a.col, b.col), a.dtype, b.never_null)  # once, not to test it and to give it
    return merge(a.is_nil(), b, a)


def strict_equal(a: Val, b: Val) -> Column:
    if a.kind == "null":
        return b.is_nil()
    if b.kind == "null":
        return a.is_nil()
    if "any" in (a.kind, b.kind):
        same = F.coalesce(a.number() == b.number(), a.string() == b.string(), a.boolean() == b.boolean(), F.lit(False))
        return F.when(a.is_nil() | b.is_nil(), a.is_nil() & b.is_nil()).otherwise(same)
    if a.kind != b.kind or a.kind in ("arr", "obj"):
        return F.lit(False) if a.never_null or b.never_null else a.col.isNull() & b.col.isNull()
    x, y = (a.col.cast("double"), b.col.cast("double")) if a.kind == "num" else (a.col, b.col)
    return x.eqNullSafe(y)


def compare(op: str, a: Val, b: Val) -> Column:
    apply: Callable[[Column, Column], Column] = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    equal = F.lit(op in ("<=", ">="))
    number = apply(a.number(), b.rule_number_of())
    if a.kind == "num":
        return F.when(a.col.isNull(), equal).otherwise(number) if not a.never_null else number
    bytes_ = lambda v: v.string_of().cast("binary")
    if a.kind == "str":
        return F.when(a.is_null(), equal).otherwise(apply(a.col.cast("binary"), bytes_(b)))
    if a.kind == "any":
        return F.when(a.is_number(), number).when(a.is_string(), apply(a.string().cast("binary"), bytes_(b))).otherwise(equal)
    return equal


def add(a: Val, b: Val) -> Val:
    if a.kind == "null":
        return b
    if a.kind == "str":
        joined = F.concat(a.string_of(), b.string_of())
        return text(joined) if a.never_null else Val(F.when(a.col.isNull(), b.string_of()).otherwise(joined), STR)
    if a.kind == "num":
        return num(F.coalesce(a.number(), F.lit(0.0)) + b.rule_number_of())
    if a.kind == "any":
        number = Val(a.number() + b.rule_number_of(), NUM)
        joined = Val(F.when(a.is_string(), F.concat(a.string_of(), b.string_of())), STR)
        return merge(a.is_number(), number, merge(a.is_nil(), b, joined))
    raise NotLowerable(f"+ on {a.kind}")


def member(x: Val, group: Val) -> Column:
    if group.const is not ABSENT and isinstance(group.const, list):
        return reduce(lambda a, b: a | b, (strict_equal(x, literal(v)) for v in group.const), F.lit(False))
    if group.kind == "arr":
        return F.coalesce(F.exists(group.col, lambda e: strict_equal(x, Val(e, group.dtype.elementType))), F.lit(False))
    if group.kind == "obj":
        return F.array_contains(group.keys(), x.string_of())
    if group.kind == "any":
        in_array = F.exists(group.array()[0], lambda e: strict_equal(x, Val(e, T.VariantType())))
        return F.coalesce(in_array, F.array_contains(group.keys(), x.string_of()), strict_equal(x, group))
    return strict_equal(x, group)


class Lowerer:
    """One program; `env` has the variables so far."""

    def __init__(self, env: dict[str, Val], flags: Flags = Flags()) -> None:
        self.env, self.flags = dict(env), flags
        #: What was returned, and whether anything was; None while no return was seen.
        self.returned: list[Val] | None = None
        self.done: Column | None = None
        #: Whether returns differ in how many values they have.
        self.ragged = False

    def value(self, n: p.Node) -> Val:
        method = getattr(self, "on_" + type(n).__name__, None)
        if method is None:
            raise NotLowerable(type(n).__name__)
        return method(n)

    def on_Lit(self, n: p.Lit) -> Val:
        return nil() if n.value is None else literal(n.value)

    def on_Name(self, n: p.Name) -> Val:
        return self.env.get(n.name) or nil()

    def on_Discard(self, n: p.Discard) -> Val:
        return nil()

    def on_Interp(self, n: p.Interp) -> Val:
        return text(F.concat(*(F.lit(x) if isinstance(x, str) else self.value(x).string_of() for x in n.parts)))

    def on_Bin(self, n: p.Bin) -> Val:
        a, b = self.value(n.left), self.value(n.right)
        x, y = (lambda: as_double(a)), (lambda: as_double(b))
        if n.op == "+":
            return add(a, b)
        if n.op in ("-", "*"):
            return num(x() - y() if n.op == "-" else x() * y())
        if n.op == "/":
            return num(div_column(x(), y()))
        if n.op == "%":
            d = y().cast("bigint")
            return Val(F.when(d != 0, (x().cast("bigint") % F.when(d != 0, d)).cast("double")), NUM)
        if n.op == "^":
            return num(F.pow(x(), y()))
        if n.op in ("&", "|"):
            return num((as_long(a).bitwiseAND(as_long(b)) if n.op == "&" else as_long(a).bitwiseOR(as_long(b))).cast("double"))
        if n.op in ("==", "!="):
            same = strict_equal(a, b)
            return boolean(same if n.op == "==" else ~same)
        if n.op in ("<", "<=", ">", ">="):
            return boolean(compare(n.op, a, b))
        if n.op in ("&&", "||"):
            return boolean(a.condition() & b.condition() if n.op == "&&" else a.condition() | b.condition())
        if n.op == "or":
            return _or_else(a, b)
        if n.op == "in":
            return boolean(member(a, b))
        raise NotLowerable(n.op)

    def on_Unary(self, n: p.Unary) -> Val:
        v = self.value(n.of)
        if n.op == "!":
            return boolean(~v.condition())
        if v.const is not ABSENT and isinstance(v.const, float):
            return literal(-v.const)
        return num(-as_double(v))

    def on_Ternary(self, n: p.Ternary) -> Val:
        test = self.value(n.test).condition()
        return self._branches([(test, n.yes)], n.no)

    def on_IfChain(self, n: p.IfChain) -> Val:
        pending = [(self.value(t).condition(), body) for t, body in n.branches]
        return self._branches(pending, n.other)

    def on_SwitchChain(self, n: p.SwitchChain) -> Val:
        subject = self.value(n.subject)
        return self._branches([(strict_equal(subject, self.value(t)), body) for t, body in n.cases], n.other)

    def _branches(self, branches: list, other: p.Node | None) -> Val:
        """Runs each branch on a copy of the environment and merges what they assign and return."""
        if not branches:
            return self.value(other) if other else nil()
        (test, body), rest = branches[0], branches[1:]
        start = (dict(self.env), self.returned, self.done)
        yes = self.value(body)
        env_yes, ret_yes, done_yes = self.env, self.returned, self.done
        self.env, self.returned, self.done = dict(start[0]), start[1], start[2]
        no = self._branches(rest, other)
        env_no, ret_no, done_no = self.env, self.returned, self.done
        merged = {}
        for k in {*env_yes, *env_no}:
            a, b = env_yes.get(k) or nil(), env_no.get(k) or nil()
            merged[k] = a if a is b else merge(test, a, b)
        self.env = merged
        if done_yes is not done_no or ret_yes is not ret_no:
            off = F.lit(False)
            self.done = F.when(test, off if done_yes is None else done_yes).otherwise(off if done_no is None else done_no)
            n = max(len(ret_yes or []), len(ret_no or []))
            self.ragged |= ret_yes is not None and ret_no is not None and len(ret_yes) != len(ret_no)
            pad = lambda r: [*(r or []), *([nil()] * (n - len(r or [])))]
            self.returned = [merge(test, a, b) for a, b in zip(pad(ret_yes), pad(ret_no), strict=True)]
        return merge(test, yes, no)

    def on_Assign(self, n: p.Assign) -> Val:
        if isinstance(n.value, p.Lambda):
            raise NotLowerable("a lambda as a value")
        return self._assign(n.target, self.value(n.value))

    def _assign(self, target: p.Node, value: Val) -> Val:
        if isinstance(target, p.Discard):
            return value
        if not isinstance(target, p.Name):
            raise NotLowerable("a write into a value")
        if self.done is not None:
            value = merge(self.done, self.env.get(target.name) or nil(), value)
        self.env[target.name] = value
        return value

    def on_AddAssign(self, n: p.AddAssign) -> Val:
        return self._assign(n.target, add(self.value(n.target), self.value(n.value)))

    def on_Bump(self, n: p.Bump) -> Val:
        return self._assign(n.target, num(self.value(n.target).rule_number_of() + n.by))

    def on_As(self, n: p.As) -> Val:
        return self._assign(p.Name(n.name), self.value(n.value))

    def on_Seq(self, n: p.Seq) -> Val:
        out = nil()
        for item in n.items:
            out = self.value(item)
        return out

    def on_Return(self, n: p.Return) -> Val:
        return self._return([self.value(v) for v in n.values])

    def _return(self, values: list[Val]) -> Val:
        if self.done is None:
            self.returned, self.done = values, F.lit(True)
        else:
            self.ragged |= self.returned is not None and len(self.returned) != len(values)
            before = [*(self.returned or []), *([nil()] * (len(values) - len(self.returned or [])))]
            after = [*values, *([nil()] * (len(before) - len(values)))]
            self.returned = [merge(self.done, a, b) for a, b in zip(before, after, strict=True)]
            self.done = F.lit(True)
        return values[-1] if values else nil()

    def on_Must(self, n: p.Must) -> Val:
        v = self.value(n.of)
        if v.never_null:
            return v
        return Val(F.when(v.is_nil(), F.raise_error(F.lit("value is nil")).cast(v.dtype)).otherwise(v.col), v.dtype, True)

    def on_Field(self, n: p.Field) -> Val:
        return self.value(n.of).get(n.name)

    def on_At(self, n: p.At) -> Val:
        of, index = self.value(n.of), self.value(n.index)
        if index.const is not ABSENT and isinstance(index.const, str):
            return of.get(index.const)
        if of.kind in ("arr", "any"):
            if index.const is not ABSENT and isinstance(index.const, float):
                return of.at(int(index.const))
            arr, kind = of.array()
            k = as_double(index).cast("int")
            return Val(F.when(k >= 0, F.get(arr, k)), kind)
        if isinstance(of.dtype, T.MapType):
            return Val(F.try_element_at(of.col, index.string_of()), of.dtype.valueType)
        raise NotLowerable("an index on this kind")

    def on_Slice(self, n: p.Slice) -> Val:
        of = self.value(n.of)
        size = F.size(of.array()[0]) if of.kind in ("arr",) else F.octet_length(of.col)
        a = F.lit(0) if n.start is None else as_double(self.value(n.start)).cast("int")
        b = size if n.end is None else as_double(self.value(n.end)).cast("int")
        good = (a >= 0) & (a <= b) & (b <= size)
        if of.kind == "arr":
            return Val(F.when(good, F.slice(of.col, F.when(good, a + 1).otherwise(1), F.when(good, b - a).otherwise(0))), of.dtype)
        if of.kind == "str":
            return Val(F.when(good, _byte_slice(of.col, a, b)), STR)
        if of.kind == "bytes":
            return Val(F.when(good, F.substring(of.col, a + 1, b - a)), BIN)
        raise NotLowerable("a slice of this kind")

    def on_ArrayLit(self, n: p.ArrayLit) -> Val:
        items = [self.value(x) for x in n.items]
        if all(i.const is not ABSENT for i in items):
            return literal([i.const for i in items])
        return array_of(items)

    def on_MapLit(self, n: p.MapLit) -> Val:
        items = [(self.value(k), self.value(v)) for k, v in n.items]
        if all(v.const is not ABSENT and k.const is not ABSENT for k, v in items):
            return literal({string_of(k.const): v.const for k, v in items})
        pairs = [c for k, v in items for c in (k.string_of(), v.variant())]
        return Val(F.create_map(*pairs), T.MapType(STR, T.VariantType()), True)

    def on_For(self, n: p.For) -> Val:
        return self._loop(self.value(n.over), n.key, n.value, n.body)

    def _loop(self, over: Val, key: str | None, name: str, body: p.Node) -> Val:
        """Iterates an array; state is the variables the body assigns."""
        if over.kind not in ("arr", "any"):
            raise NotLowerable("a loop over this kind")
        names = sorted(assigned(body))
        arr, kind = over.array()
        if not names:
            return nil()

        def one(state: dict[str, Val], element: Val, index: Column) -> dict[str, Val]:
            inner = Lowerer(self.env | state | {name: element} | ({key: num(index)} if key else {}), self.flags)
            inner.value(body)
            if inner.done is not None:
                raise NotLowerable("return inside a loop")
            return {k: inner.env.get(k) or nil() for k in names}

        start = {k: self.env.get(k) or nil() for k in names}
        kinds = {k: start[k].dtype for k in names}
        for _ in range(4):  # until the kinds of the state settle
            probe = {k: Val(F.lit(None).cast(kinds[k]) if kinds[k] is not None else F.lit(None).cast("variant"), kinds[k]) for k in names}
            after = one(probe, Val(F.lit(None).cast(kind), kind), F.lit(0.0))
            new = {k: _common(kinds[k], after[k]) for k in names}
            if new == kinds:
                break
            kinds = new
        if any(kinds[k] is None for k in names):
            raise NotLowerable("a loop variable that stays nil")
        begin = F.struct(F.lit(0.0).alias("i"), *(_to(start[k], kinds[k]).alias(f"v{i}") for i, k in enumerate(names)))

        def step(acc: Column, x: Column) -> Column:
            state = {k: Val(acc[f"v{i}"], kinds[k]) for i, k in enumerate(names)}
            after = one(state, Val(x, kind), acc["i"])
            return F.struct((acc["i"] + 1).alias("i"), *(_to(after[k], kinds[k]).alias(f"v{i}") for i, k in enumerate(names)))

        result = F.aggregate(F.coalesce(arr, F.array().cast(T.ArrayType(kind))), begin, step)
        for i, k in enumerate(names):
            self.env[k] = Val(result[f"v{i}"], kinds[k])
        return nil()

    def on_Call(self, n: p.Call) -> Val:
        if n.name == "return":
            return self._return([self.value(a) for a in n.args])
        if n.name == "ternary":
            return self._branches([(self.value(n.args[0]).condition(), n.args[1])], n.args[2])
        if n.name in ("for", "all"):
            return self._iterate(n.name, self.value(n.args[0]), n.args[1])
        if n.name in ("catch", "unwrap"):
            return self.value(n.args[0])
        if n.name in ("set_to", "seto"):
            return self._assign(n.args[1], self.value(n.args[0]))
        make = CALLS.get(n.name)
        if make is None:
            raise NotLowerable(f"function {n.name}")
        return make(*self._arguments(n.args))

    def _arguments(self, args: tuple) -> list[Val]:
        if any(isinstance(a, (p.Spread, p.Lambda)) for a in args):
            raise NotLowerable("spread or lambda arguments")
        return [self.value(a) for a in args]

    def _iterate(self, name: str, over: Val, body: p.Node) -> Val:
        if isinstance(body, p.Lambda) and name == "for":
            key, value = body.params if len(body.params) == 2 else (None, body.params[0])
            return self._loop(over, key, value, body.body)
        if isinstance(body, p.Lambda) and over.kind in ("arr", "any"):
            arr, kind = over.array()
            return Val(F.filter(arr, lambda x, i: self._inline(body, x, kind, i).condition()), T.ArrayType(kind), over.never_null)
        raise NotLowerable(name)

    def _inline(self, body: p.Lambda, x: Column, kind: T.DataType, index: Column | None = None) -> Val:
        if assigned(body.body):
            raise NotLowerable("a lambda that assigns")
        names = body.params if len(body.params) == 1 else body.params[1:]
        env = self.env | {names[0]: Val(x, kind)}
        if len(body.params) == 2 and index is not None:
            env[body.params[0]] = num(index.cast("double"))
        return Lowerer(env, self.flags).value(body.body)

    def on_Method(self, n: p.Method) -> Val:
        of = self.value(n.of)
        if n.name in ("set_to", "seto"):
            return self._assign(n.args[0], of)
        if n.name in ("catch", "unwrap"):
            return of
        if n.args and isinstance(n.args[0], p.Lambda):
            return self._higher_order(of, n.name, n.args[0])
        args = self._arguments(n.args)
        kind = "arr" if of.kind == "any" and n.name in ARRAY_ONLY else "obj" if of.kind == "any" and n.name in MAP_ONLY else of.kind
        make = METHODS.get((kind, n.name)) or METHODS.get(("*", n.name))
        if make is None and of.kind == "any":
            make = METHODS.get(("str", n.name))
            of = Val(of.string(), STR)
        if make is None:
            raise NotLowerable(f"method {n.name} of {of.kind}")
        return make(of, *args)

    def _higher_order(self, of: Val, name: str, body: p.Lambda) -> Val:
        if name == "for":
            return self._iterate("for", of, body)
        if of.kind not in ("arr", "any"):
            raise NotLowerable(f"{name} on {of.kind}")
        arr, kind = of.array()
        if name == "all":
            return Val(F.filter(arr, lambda x, i: self._inline(body, x, kind, i).condition()), T.ArrayType(kind), of.never_null)
        if name == "filter":
            probe = self._inline(body, F.lit(None).cast(kind), kind, F.lit(0))
            if probe.kind == "null":
                raise NotLowerable("a lambda that is nil")
            return Val(F.transform(arr, lambda x, i: self._inline(body, x, kind, i).col), T.ArrayType(probe.dtype), of.never_null)
        if name == "sort" and kind != T.VariantType():
            a, b = body.params

            def order(x: Column, y: Column) -> Column:
                less = Lowerer(self.env | {a: Val(x, kind), b: Val(y, kind)}, self.flags).value(body.body).condition()
                return F.when(strict_equal(Val(x, kind), Val(y, kind)), 0).when(less, -1).otherwise(1)

            return Val(F.array_sort(arr, order), of.dtype if of.kind == "arr" else T.ArrayType(kind), of.never_null)
        raise NotLowerable(f"{name} with a lambda")


def _byte_slice(c: Column, a: Column, b: Column) -> Column:
    """Bytes a to b of a text; a character cut through becomes a replacement character."""
    return F.make_valid_utf8(F.substring(c.cast("binary"), a + 1, b - a).cast("string"))


def _common(kind: T.DataType | None, value: Val) -> T.DataType | None:
    if kind is None:
        return value.dtype
    if value.dtype is None or value.dtype == kind:
        return kind
    if value.kind == "num" and Val(F.lit, kind).kind == "num":
        return NUM
    return T.VariantType()


def _to(value: Val, kind: T.DataType) -> Column:
    if value.dtype == kind:
        return value.col
    if isinstance(kind, T.VariantType):
        return F.when(~value.is_nil(), value.variant()) if value.kind != "null" else F.lit(None).cast("variant")
    return F.lit(None).cast(kind) if value.kind == "null" else value.col.cast(kind)


def array_of(items: list[Val]) -> Val:
    kinds = {i.kind for i in items}
    if kinds == {"num"}:
        return Val(F.array(*(i.col.cast("double") for i in items)), T.ArrayType(NUM), True)
    if len(kinds) == 1 and kinds <= {"str", "bool"}:
        return Val(F.array(*(i.col for i in items)), T.ArrayType(items[0].dtype), True)
    return Val(F.array(*(i.variant() for i in items)), T.ArrayType(T.VariantType()), True)


def assigned(node) -> set[str]:
    """Variables that a node may write."""
    found: set[str] = set()
    if isinstance(node, (p.Assign, p.AddAssign, p.Bump)):
        target = node.target
        while isinstance(target, (p.Field, p.At)):
            target = target.of
        if isinstance(target, p.Name):
            found.add(target.name)
    if isinstance(node, p.As):
        found.add(node.name)
    if isinstance(node, (p.Call, p.Method)) and node.name in ("set_to", "seto") and isinstance(node.args[-1], p.Name):
        found.add(node.args[-1].name)
    for value in vars(node).values() if isinstance(node, p.Node) else ():
        for item in value if isinstance(value, tuple) else (value,):
            for part in item if isinstance(item, tuple) else (item,):
                if isinstance(part, p.Node):
                    found |= assigned(part)
    return found


# ---- functions and methods -------------------------------------------------------------

s, q = (lambda v: v.string_or_empty()), constant_of


def _bytes_of(v: Val) -> Column:
    return v.col if v.kind == "bytes" else v.string_of().cast("binary")


def _split(v: Val, sep: Val, n: Val | None = None) -> Val:
    limit = int(q(n)) if n is not None else -1
    literal_sep = F.concat(F.lit("\\Q"), s(sep), F.lit("\\E"))
    return Val(F.split(s(v), literal_sep, limit if limit > 0 else -1), T.ArrayType(STR), True)


def _split_after(v: Val, sep: Val, n: Val | None = None) -> Val:
    parts = _split(v, sep, n).col
    last = F.size(parts) - 1
    return Val(F.transform(parts, lambda x, i: F.when(i < last, F.concat(x, s(sep))).otherwise(x)), T.ArrayType(STR), True)


def _join(v: Val, sep: Val | None = None) -> Val:
    return text(F.coalesce(F.array_join(v.each(lambda x: x.string_of()), q(sep) if sep is not None else ""), F.lit("")))


def _index(v: Val, x: Val) -> Val:
    at = F.instr(s(v), q(x)) if x.const is not ABSENT else F.locate(F.lit(""), s(v))
    if x.const is ABSENT:
        raise NotLowerable("index of a text that is not constant")
    return num(F.when(at > 0, F.octet_length(F.substring(s(v), F.lit(1), at - 1))).otherwise(-1).cast("double"))


def _affix(prefix: bool):
    def make(v: Val, x: Val) -> Val:
        a, b = s(v), s(x)
        if prefix:
            return text(F.when(a.startswith(b), F.substring(a, F.length(b) + 1, F.length(a))).otherwise(a))
        return text(F.when(a.endswith(b), F.substring(a, F.lit(1), F.length(a) - F.length(b))).otherwise(a))

    return make


def _string_slice(v: Val, a: Val, b: Val) -> Val:
    x, y, n = as_double(a).cast("int"), as_double(b).cast("int"), F.octet_length(s(v))
    return text(F.when((x >= 0) & (x <= y) & (y <= n), _byte_slice(s(v), x, y)).otherwise(""))


def _array_slice(v: Val, a: Val, b: Val) -> Val:
    arr, kind = v.array()
    x, y = as_double(a).cast("int"), as_double(b).cast("int")
    good = (x >= 0) & (x <= y) & (y <= F.size(arr))
    return Val(F.when(good, F.slice(arr, F.when(good, x + 1).otherwise(1), F.when(good, y - x).otherwise(0))), T.ArrayType(kind))


def _find_all(pattern: Val, v: Val) -> Val:
    import re as _re

    rule = q(pattern).replace("(?P<", "(?<")
    groups = _re.compile(_re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", rule)).groups
    found = [F.regexp_extract_all(s(v), F.lit(rule), F.lit(k)) for k in range(groups + 1)]
    return _Matches(found)


class _Matches(Val):
    """Matches of a pattern, of which each is an array of its groups; made of an array for each group, so that a part asks for its own alone."""

    def __init__(self, found: list[Column]) -> None:
        self.found = found
        if len(found) == 1:
            rows = F.transform(found[0], lambda x: F.array(x))
        else:  # zipped, since what stands in a lambda is computed for each element: all matches of the text for each match
            rows = F.transform(F.arrays_zip(*(g.alias(f"g{k}") for k, g in enumerate(found))), lambda x: F.array(*(x[f"g{k}"] for k in range(len(found)))))
        super().__init__(rows, T.ArrayType(T.ArrayType(STR)), True)

    def at(self, index: int) -> Val:
        return _Match(self, index) if index >= 0 else super().at(index)


class _Match(Val):
    def __init__(self, of: _Matches, index: int) -> None:
        self.of, self.index = of, index
        super().__init__(F.get(of.col, index), T.ArrayType(STR))

    def at(self, index: int) -> Val:
        return Val(F.get(self.of.found[index], self.index), STR) if 0 <= index < len(self.of.found) else super().at(index)


def _len(v: Val) -> Val:
    if v.kind == "str":
        return num(F.coalesce(F.octet_length(v.col), F.lit(0)).cast("double"))
    if v.kind == "bytes":
        return num(F.coalesce(F.octet_length(v.col), F.lit(0)).cast("double"))
    if v.kind == "null":
        return literal(0.0)
    parts = [F.octet_length(v.string())] if v.kind == "any" else []
    parts += [F.size(v.array()[0])] if v.kind in ("arr", "any") else []
    parts += [F.size(v.keys())] if v.kind in ("obj", "any") else []
    return num(F.coalesce(*parts, F.lit(0)).cast("double"))


def _is_empty(v: Val) -> Val:
    if v.kind in ("num", "bool", "time", "obj"):
        return boolean(v.is_nil())
    empty = [v.string() == ""] if v.kind in ("str", "any") else []
    empty += [F.size(v.array()[0]) == 0] if v.kind in ("arr", "any") else []
    return boolean(v.is_nil() | F.coalesce(*empty, F.lit(False)))


def _type(v: Val) -> Val:
    names = {"str": "string", "num": "number", "bool": "boolean", "arr": "array", "obj": "map[string]interface {}", "bytes": "bytes", "time": "time.Time"}
    if v.kind == "null":
        return literal("nil")
    if v.kind != "any":
        return text(F.when(v.is_nil(), "nil").otherwise(names[v.kind]))
    return text(F.when(v.is_nil(), "nil").when(v.is_string(), "string").when(v.is_number(), "number").when(v.is_bool(), "boolean").when(v.is_array(), "array").otherwise(names["obj"]))


def _add_all(*args: Val) -> Val:
    first = args[0]
    if first.kind == "num":
        return num(reduce(lambda a, b: a + b, (a.rule_number_of() for a in args)))
    if first.kind in ("str", "null", "bool"):
        return text(F.concat(*(a.string_of() for a in args)))
    raise NotLowerable("add on this kind")


def _append(*args: Val) -> Val:
    if args[0].kind == "str":
        return text(F.concat(*(a.string_of() for a in args)))
    if args[0].kind == "arr":
        kind = args[0].dtype.elementType
        return Val(F.concat(args[0].col, F.array(*(_to(a, kind) for a in args[1:]))), args[0].dtype, args[0].never_null)
    if args[0].kind == "null":
        return array_of(list(args[1:]))
    raise NotLowerable("append on this kind")


def _first_truthy(*args: Val) -> Val:
    out = nil()
    for a in reversed(args):
        out = merge(a.rule_bool_of(), a, out)
    return out


def _map_keys(v: Val) -> Val:
    return Val(F.array_sort(v.keys()), T.ArrayType(STR), True)


def _map_filter(keep: bool):
    def make(v: Val, *keys: Val) -> Val:
        names = [string_of(x) for k in keys for x in (q(k) if isinstance(q(k), list) else [q(k)])]
        return Val(F.map_filter(v.map(), lambda k, _: k.isin(names) if keep else ~k.isin(names)), T.MapType(STR, T.VariantType()))

    return make


def _map_text(v: Val, a: Val, b: Val) -> Val:
    by_key = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    pairs = F.transform(F.array_sort(F.map_entries(v.map()), by_key), lambda e: F.concat(e["key"], F.lit(q(a)), Val(e["value"], T.VariantType()).string_of()))
    return text(F.array_join(pairs, q(b)))


def _merge_maps(v: Val, *others: Val) -> Val:
    def onto(out: Column) -> Callable[[Column], Column]:
        return lambda more: F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(more, k)), more)

    out = v.map()
    for o in others:
        out = let(F.coalesce(o.map(), F.create_map().cast("map<string,variant>")), onto(out))
    return Val(out, T.MapType(STR, T.VariantType()))


def _json_text(v: Val) -> Val:
    return text(F.to_json(v.variant()))


def _normal(v: Val) -> Column:
    return F.to_json(v.variant())


def _timestamp(v: Val) -> Column:
    return v.col.cast("timestamp") if v.kind == "time" and isinstance(v.dtype, T.DateType) else v.col


def _part(f: Callable[[Column], Column]):
    return lambda v: num(f(_timestamp(v)).cast("double"))


def _unix(f: Callable[[Column], Column], unit: int):
    def make(v: Val) -> Val:
        if isinstance(v.dtype, T.TimestampNTZType):
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            micros = F.timestamp_diff("MICROSECOND", epoch, v.col)
            return num(F.floor(micros / (1_000_000 // unit)).cast("double"))
        return num(f(_timestamp(v)).cast("double"))

    return make


def _sub_time(a: Val, b: Val) -> Val:
    return num(F.timestamp_diff("MICROSECOND", b.col, a.col).cast("double") / 1000)


def _add_mill(v: Val, n: Val) -> Val:
    return Val(v.col + F.make_dt_interval(secs=(as_double(n) / 1000).cast("decimal(18,6)")), v.dtype, v.never_null)


def _format_time(v: Val, layout: Val) -> Val:
    return text(F.date_format(_timestamp(v), gotime.spark_pattern(q(layout))))


def _parse_time(layout: Val, v: Val) -> Val:
    return Val(F.try_to_timestamp(s(v), F.lit(gotime.spark_pattern(q(layout)))), TIME)


def _hmac(data: Val, key: Val) -> Val:
    """HMAC-SHA256 of a key of at most 64 bytes, from sha2 alone, where the key is constant."""
    k = string_of(q(key)).encode()
    import hashlib

    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in k)), _bytes_of(data)), 256))
    return binary(F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in k)), inner), 256)))


def _cut(v: Val, a: Val, b: Val) -> Val:
    arr, kind = v.array()
    x = as_double(a).cast("int")
    y = F.least(as_double(b).cast("int"), F.size(arr))
    good = (x >= 0) & (x <= y)
    return Val(F.when(good, F.slice(arr, F.when(good, x + 1).otherwise(1), F.when(good, y - x).otherwise(0))), T.ArrayType(kind))


def _nils(n: Val) -> Val:
    return Val(F.array_repeat(F.lit(None).cast("variant"), as_double(n).cast("int")), T.ArrayType(T.VariantType()), True)


_regmatch = lambda pattern, v: boolean(s(v).rlike(q(pattern).replace("(?P<", "(?<")))
_b64 = lambda v: text(F.base64(_bytes_of(v)))
_unb64 = lambda v: binary(F.try_to_binary(v.string_of(), F.lit("base64")))
_hex = lambda v: text(F.lower(F.hex(_bytes_of(v))))
_md5 = lambda v: binary(F.unhex(F.md5(_bytes_of(v))))
_get = lambda v, k: v.get(string_of(q(k))) if not isinstance(q(k), float) else v.at(int(q(k)))
_fields = lambda v: Val(F.filter(F.split(s(v), r"\s+"), lambda x: x != ""), T.ArrayType(STR), True)
_trim_space = lambda v: text(F.regexp_replace(s(v), r"^\s+|\s+\z", ""))
_string = lambda v: text(F.decode(v.col, "utf-8")) if v.kind == "bytes" else text(v.string_of())
_eqs = lambda a, b: boolean(strict_equal(a, b) | (a.string_of() == b.string_of()))

CALLS: dict[str, Callable[..., Val]] = {
    "add": _add_all, "sub": lambda a, b: num(as_double(a) - as_double(b)), "mul": lambda a, b: num(as_double(a) * as_double(b)), "div": lambda a, b: num(div_column(as_double(a), as_double(b))),
    "mod": lambda a, b: Lowerer({"a": a, "b": b}).value(p.Bin("%", p.Name("a"), p.Name("b"))), "pow": lambda a, b: num(F.pow(as_double(a), as_double(b))), "neg": lambda a: num(-as_double(a)),
    "sqrt": lambda a: num(F.sqrt(as_double(a))), "log10": lambda a: num(F.coalesce(F.log10(as_double(a)), F.when(as_double(a) == 0, float("-inf")).otherwise(float("nan")))),
    "eq": lambda a, b: boolean(strict_equal(a, b)), "neq": lambda a, b: boolean(~strict_equal(a, b)), "eqs": _eqs, "neqs": lambda a, b: boolean(~_eqs(a, b).col),
    "lt": lambda a, b: boolean(compare("<", a, b)), "lte": lambda a, b: boolean(compare("<=", a, b)), "gt": lambda a, b: boolean(compare(">", a, b)), "gte": lambda a, b: boolean(compare(">=", a, b)),
    "not": lambda a: boolean(~a.condition()), "and": lambda *a: boolean(reduce(lambda x, y: x & y, (v.condition() for v in a))), "or": _first_truthy, "orr": _or_else,
    "inn": lambda x, *g: boolean(reduce(lambda a, b: a | b, (member(x, y) for y in g))), "is_empty": _is_empty,
    "string": _string, "number": lambda v: num(v.rule_number_of()), "bool": lambda v: boolean(v.rule_bool_of()), "boolean": lambda v: boolean(v.rule_bool_of()),
    "int": lambda v: num(F.coalesce(as_double(v).try_cast("bigint").cast("double"), as_double(v))), "bytes": lambda v: binary(_bytes_of(v)), "type": _type, "len": _len,
    "append": _append, "join": _join, "str_join": _join, "str_has_prefix": lambda v, x: boolean(s(v).startswith(s(x))), "str_has_suffix": lambda v, x: boolean(s(v).endswith(s(x))),
    "str_split": _split_after, "str_to_upper": lambda v: text(F.upper(s(v))), "str_to_lower": lambda v: text(F.lower(s(v))), "str_trim": _trim_space, "str_fields": _fields,
    "regmatch": _regmatch, "regfind": _find_all, "json_to": _json_text, "to_json_str": _json_text, "json_from": lambda v: Val(F.try_parse_json(v.string_of()), T.VariantType()), "to_json_obj": lambda v: Val(F.try_parse_json(v.string_of()), T.VariantType()),
    "base64_encode": _b64, "base64_decode": _unb64, "hex_encode": _hex, "hex_decode": lambda v: binary(F.unhex(v.string_of())), "md5_sum": _md5,
    "sha256_sum": lambda v: binary(F.unhex(F.sha2(_bytes_of(v), 256))), "hmac_sha256": _hmac,
    "time_now": lambda: Val(F.current_timestamp(), TIME, True), "time_from_unix": lambda n: Val(F.timestamp_seconds(as_double(n)), TIME, True), "time_format": _format_time, "time_parse": _parse_time,
    "duration": lambda v: Val(F.make_dt_interval(secs=F.lit(gotime.parse_duration(q(v)).total_seconds()).cast("decimal(18,6)")), None),
    "slice_init": lambda *a: array_of(list(a)), "slice_cut": _cut, "slice_new": _nils, "range": _nils, "new": lambda: literal({}), "get": _get,
}

ARRAY_ONLY = {"join", "sort", "all", "filter"}
MAP_ONLY = {"keys", "merge", "exclude", "some", "equals", "to_string"}
METHODS: dict[tuple[str, str], Callable[..., Val]] = {
    ("*", n): CALLS[n] for n in ("string", "number", "bool", "boolean", "type", "is_empty", "to_json_str")
} | {("*", "json_str"): _json_text, ("*", "len"): _len, ("*", "clone"): lambda v: v} | {("str", n): f for n, f in {
    "has_prefix": CALLS["str_has_prefix"], "has_suffix": CALLS["str_has_suffix"], "has": lambda v, x: boolean(s(v).contains(s(x))), "contains": lambda v, x: boolean(s(v).contains(s(x))),
    "trim_space": _trim_space, "trim": lambda v, x: text(F.trim(s(v), s(x))), "trim_left": lambda v, x: text(F.ltrim(s(v), s(x))), "trim_right": lambda v, x: text(F.rtrim(s(v), s(x))),
    "trim_prefix": _affix(True), "trim_suffix": _affix(False), "slice": _string_slice, "index": _index, "bytes": lambda v: binary(_bytes_of(v)), "md5": _md5, "hex": _hex, "base64": _b64, "base64d": _unb64,
    "split": _split, "fields": _fields, "replace": lambda v, a, b: text(F.replace(s(v), s(a), s(b))), "to_upper": lambda v: text(F.upper(s(v))), "to_lower": lambda v: text(F.lower(s(v))),
}.items()} | {("arr", n): f for n, f in {"slice": _array_slice, "get": _get, "join": _join}.items()} | {("obj", n): f for n, f in {
    "get": _get, "keys": _map_keys, "merge": _merge_maps, "exclude": _map_filter(False), "some": _map_filter(True), "equals": lambda a, b: boolean(_normal(a) == _normal(b)), "to_string": _map_text,
}.items()} | {("bytes", n): f for n, f in {
    "hex": _hex, "base64": _b64, "base64d": lambda v: binary(F.try_to_binary(F.decode(v.col, "utf-8"), F.lit("base64"))), "md5": _md5, "bytes": lambda v: v, "copy": lambda v: v,
}.items()} | {("num", "time"): CALLS["time_from_unix"]} | {("time", n): f for n, f in {
    "year": _part(F.year), "month": _part(F.month), "day": _part(F.dayofmonth), "hour": _part(F.hour), "minute": _part(F.minute), "second": _part(F.second),
    "unix": _unix(F.unix_seconds, 1), "unix_mill": _unix(F.unix_millis, 1000), "unix_micro": _unix(F.unix_micros, 1_000_000), "format": _format_time, "add_mill": _add_mill, "sub": _sub_time,
}.items()}


def register_column_function(name: str, make: Callable[..., Val]) -> None:
    """Give a registered rule function a Column form: make(*vals) -> Val."""
    CALLS[name] = make


def register_column_method(kind: str, name: str, make: Callable[..., Val]) -> None:
    METHODS[kind, name] = make
