"""The rule language on plain values: exact for every construct, run in Arrow batches or on the driver.

Variables are one flat table, which lambdas share. Errors stop the program and are kept
in `error`; `catch`, `unwrap` and `recover` turn them into values.
"""

from __future__ import annotations

import copy
import datetime as dt
import math
import time
import traceback
from collections.abc import Callable
from typing import Any

from docloom.functions.templates import ieee_div
from docloom.functions.values import Flags, compare, condition, rule_number_of, strict_equal, string_of
from docloom.plans.rules import parser as p
from docloom.plans.rules import registry as f
from docloom.plans.rules.registry import Failure

#: Iterations that `loop` may take.
STEP_BUDGET = 1_000_000


class ErrorValue:
    def __init__(self, text: str) -> None:
        self.text = text

    def __str__(self) -> str:
        return self.text


class ReturnSignal(Exception):
    def __init__(self, values: list) -> None:
        self.values = values


class BreakSignal(Exception):
    pass


class LambdaValue:
    def __init__(self, params: tuple, body: p.Node) -> None:
        self.params, self.body = params, body


def number(value: Any) -> float:
    """By type assertion: another kind is 0."""
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else 0.0


def add(a: Any, b: Any) -> Any:
    if a is None:
        return b
    if isinstance(a, str):
        return a + string_of(b)
    if isinstance(a, (int, float)) and not isinstance(a, bool):
        return a + rule_number_of(b)
    raise Failure(f"cannot add to {type(a).__name__}")


def power(a: float, b: float) -> float:
    try:
        out = math.pow(a, b)
    except OverflowError:
        return math.inf
    except (ValueError, ZeroDivisionError):
        return math.nan if a < 0 else math.inf
    return out


def remainder(a: float, b: float) -> float:
    if int(b) == 0:
        raise Failure("integer divide by zero")
    return math.fmod(int(a), int(b))


def whole(x: Any) -> int:
    """As a 64-bit integer, saturated."""
    return max(-(2**63), min(2**63 - 1, int(rule_number_of(x))))


def member(x: Any, group: Any) -> bool:
    if isinstance(group, list):
        return any(strict_equal(x, y) for y in group)
    if isinstance(group, dict):
        return string_of(x) in group
    return strict_equal(x, group)


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": add,
    "-": lambda a, b: number(a) - number(b),
    "*": lambda a, b: number(a) * number(b),
    "/": lambda a, b: ieee_div(number(a), number(b)),
    "%": lambda a, b: remainder(number(a), number(b)),
    "^": lambda a, b: power(number(a), number(b)),
    "&": lambda a, b: float(whole(a) & whole(b)),
    "|": lambda a, b: float(whole(a) | whole(b)),
    "==": strict_equal,
    "!=": lambda a, b: not strict_equal(a, b),
    "<": lambda a, b: compare(a, b) < 0,
    "<=": lambda a, b: compare(a, b) <= 0,
    ">": lambda a, b: compare(a, b) > 0,
    ">=": lambda a, b: compare(a, b) >= 0,
    "in": member,
}


class Machine:
    def __init__(self, variables: dict[str, Any] | None = None, flags: Flags = Flags()) -> None:
        self.vars: dict[str, Any] = dict(variables or {})
        self.flags, self.returned, self.error = flags, [], None
        self.steps = 0

    def run(self, program: p.Node) -> Any:
        """The program's value; None where it stopped by an error, which is kept."""
        try:
            return self.value(program)
        except ReturnSignal as r:
            self.returned = r.values
            return r.values[-1] if r.values else None
        except BreakSignal:
            return None
        except Failure as e:
            self.error = ErrorValue(str(e))
            return None

    def fork(self) -> Machine:
        return Machine(copy.copy(self.vars), self.flags)

    def value(self, node: p.Node) -> Any:
        return getattr(self, "on_" + type(node).__name__)(node)

    def on_Lit(self, n: p.Lit) -> Any:
        return n.value

    def on_Name(self, n: p.Name) -> Any:
        return self.vars.get(n.name)

    def on_Discard(self, n: p.Discard) -> Any:
        return None

    def on_Break(self, n: p.Break) -> Any:
        raise BreakSignal

    def on_Return(self, n: p.Return) -> Any:
        raise ReturnSignal([self.value(v) for v in n.values])

    def on_Interp(self, n: p.Interp) -> Any:
        if len(n.parts) == 1:
            return string_of(self.value(n.parts[0]))
        return "".join(x if isinstance(x, str) else string_of(self.value(x)) for x in n.parts)

    def on_Bin(self, n: p.Bin) -> Any:
        left = self.value(n.left)
        if n.op == "&&":
            return condition(left) and condition(self.value(n.right))
        if n.op == "||":
            return condition(left) or condition(self.value(n.right))
        if n.op == "or":
            return left if left is not None else self.value(n.right)
        return BINARY[n.op](left, self.value(n.right))

    def on_Unary(self, n: p.Unary) -> Any:
        x = self.value(n.of)
        return not condition(x) if n.op == "!" else -number(x)

    def on_Ternary(self, n: p.Ternary) -> Any:
        return self.value(n.yes if condition(self.value(n.test)) else n.no)

    def on_Assign(self, n: p.Assign) -> Any:
        value = self.value(n.value)
        self.assign(n.target, value)
        return value

    def on_AddAssign(self, n: p.AddAssign) -> Any:
        value = add(self.value(n.target), self.value(n.value))
        self.assign(n.target, value)
        return value

    def on_Bump(self, n: p.Bump) -> Any:
        value = rule_number_of(self.value(n.target)) + n.by
        self.assign(n.target, value)
        return value

    def on_As(self, n: p.As) -> Any:
        self.vars[n.name] = value = self.value(n.value)
        return value

    def on_Seq(self, n: p.Seq) -> Any:
        out = None
        for item in n.items:
            out = self.value(item)
        return out

    def on_Must(self, n: p.Must) -> Any:
        value = self.value(n.of)
        if value is None:
            raise Failure("value is nil")
        return value

    def on_Field(self, n: p.Field) -> Any:
        of = self.value(n.of)
        if isinstance(of, dict):
            return of.get(n.name)
        return getattr(of, n.name, None) if isinstance(of, Result) else None

    def on_At(self, n: p.At) -> Any:
        of, index = self.value(n.of), self.value(n.index)
        if isinstance(of, dict):
            return of.get(string_of(index))
        if isinstance(of, (list, bytes)) and isinstance(index, (int, float)):
            k = int(index)
            if k < 0:
                raise Failure("index out of range")
            return (float(of[k]) if isinstance(of, bytes) else of[k]) if k < len(of) else None
        return None

    def on_Slice(self, n: p.Slice) -> Any:
        of = self.value(n.of)
        a = 0 if n.start is None else int(number(self.value(n.start)))
        size = len(of.encode()) if isinstance(of, str) else len(of) if isinstance(of, (list, bytes)) else 0
        b = size if n.end is None else int(number(self.value(n.end)))
        if not isinstance(of, (list, str, bytes)) or not 0 <= a <= b <= size:
            return None
        return of.encode()[a:b].decode("utf-8", "replace") if isinstance(of, str) else of[a:b]

    def on_ArrayLit(self, n: p.ArrayLit) -> Any:
        return [self.value(x) for x in n.items]

    def on_MapLit(self, n: p.MapLit) -> Any:
        return {string_of(self.value(k)): self.value(v) for k, v in n.items}

    def on_Lambda(self, n: p.Lambda) -> Any:
        return LambdaValue(n.params, n.body)

    def on_Spread(self, n: p.Spread) -> Any:
        raise Failure("spread is only allowed among arguments")

    def on_IfChain(self, n: p.IfChain) -> Any:
        for test, body in n.branches:
            if condition(self.value(test)):
                return self.value(body)
        return self.value(n.other) if n.other else None

    def on_SwitchChain(self, n: p.SwitchChain) -> Any:
        subject = self.value(n.subject)
        for test, body in n.cases:
            if strict_equal(subject, self.value(test)):
                return self.value(body)
        return self.value(n.other) if n.other else None

    def on_For(self, n: p.For) -> Any:
        try:
            for k, v in pairs_of(self.value(n.over)):
                if n.key:
                    self.vars[n.key] = k
                self.vars[n.value] = v
                self.value(n.body)
        except BreakSignal:
            pass
        return None

    def assign(self, target: p.Node, value: Any) -> None:
        if isinstance(target, p.Discard):
            return
        if isinstance(target, p.Name):
            self.vars[target.name] = value
            return
        steps: list = []
        while isinstance(target, (p.Field, p.At)):
            steps.append(target.name if isinstance(target, p.Field) else self.value(target.index))
            target = target.of
        if not isinstance(target, p.Name):
            raise Failure("cannot assign to this expression")
        self.vars[target.name] = self._write(self.vars.get(target.name), steps[::-1], value)

    def _write(self, node: Any, steps: list, value: Any) -> Any:
        if not steps:
            return value
        step, rest = steps[0], steps[1:]
        if isinstance(step, (int, float)) and not isinstance(step, bool) and not isinstance(node, dict):
            node = node if isinstance(node, list) else []
            k = int(step)
            if k < 0:
                raise Failure("index out of range")
            node.extend([None] * (k + 1 - len(node)))
            node[k] = self._write(node[k], rest, value)
            return node
        if isinstance(node, list):  # a text index on an array is ignored
            return node
        node = node if isinstance(node, dict) else {}
        name = string_of(step)
        node[name] = self._write(node.get(name), rest, value)
        return node

    def call(self, function: Any, *args: Any) -> Any:
        """A lambda, or a Python callable bound as a variable."""
        if isinstance(function, LambdaValue):
            for name, arg in zip(function.params, args, strict=False):
                self.vars[name] = arg
            return self.value(function.body)
        if callable(function):
            return function(*args)
        raise Failure("not a function")

    def arguments(self, args: tuple) -> list:
        out = []
        for a in args:
            if isinstance(a, p.Spread):
                items = self.value(a.of)
                out += items if isinstance(items, list) else []
            else:
                out.append(self.value(a))
        return out

    def on_Call(self, n: p.Call) -> Any:
        if n.name in SPECIAL:
            return SPECIAL[n.name](self, *n.args)
        if n.name == "return":
            raise ReturnSignal(self.arguments(n.args))
        entry = f.FUNCTIONS.get(n.name)
        if entry is None:
            bound = self.vars.get(n.name)
            if bound is None:
                raise Failure(f"function {n.name!r} is not defined")
            return self.call(bound, *self.arguments(n.args))
        entry.check(n.name, len(n.args))
        return entry.run(self, *self.arguments(n.args))

    def on_Method(self, n: p.Method) -> Any:
        if n.name in SPECIAL and n.name in f.FOR_ALL:
            return SPECIAL[n.name](self, n.of, *n.args)
        of = self.value(n.of)
        found = f.method_of(of, n.name)
        if found is not None:
            return found(self, of, *self.arguments(n.args))
        if isinstance(of, dict) and n.name in of:
            return self.call(of[n.name], *self.arguments(n.args))
        if of is None and n.name not in f.FOR_ALL:
            return None
        raise Failure(f"{type(of).__name__} has no method {n.name!r}")


class Result:
    def __init__(self, err: Any, data: Any) -> None:
        self.err, self.data = err, data


def pairs_of(value: Any) -> list[tuple[Any, Any]]:
    if isinstance(value, list):
        return [(float(k), v) for k, v in enumerate(value)]
    if isinstance(value, dict):
        return sorted(value.items())
    return []


# ---- functions whose arguments are not evaluated first ----


def _ternary(m: Machine, test: p.Node, yes: p.Node, no: p.Node) -> Any:
    return m.value(yes if condition(m.value(test)) else no)


def _body(m: Machine, body: p.Node, *args: Any) -> Any:
    """A lambda body gets the arguments; another one `$key` and `$val`."""
    if isinstance(body, p.Lambda):
        return m.call(LambdaValue(body.params, body.body), *(args[-1:] if len(body.params) == 1 else args))
    if isinstance(body, p.Name) and isinstance(m.vars.get(body.name), LambdaValue):
        found = m.vars[body.name]
        return m.call(found, *(args[-1:] if len(found.params) == 1 else args))
    if len(args) == 2:
        m.vars["$key"], m.vars["$val"] = args
    return m.value(body)


def _for(m: Machine, over: p.Node, body: p.Node) -> Any:
    try:
        for k, v in pairs_of(m.value(over)):
            _body(m, body, k, v)
    except BreakSignal:
        pass
    return None


def _all(m: Machine, over: p.Node, test: p.Node) -> Any:
    return [v for k, v in pairs_of(m.value(over)) if condition(_body(m, test, k, v))]


def _loop(m: Machine, *args: p.Node) -> Any:
    test, body = args if len(args) == 2 else (p.Lit(True), args[0])
    try:
        while condition(m.value(test)):
            m.steps += 1
            if m.steps > STEP_BUDGET:
                raise Failure("loop takes too many steps")
            _body(m, body)
    except BreakSignal:
        pass
    return None


def _repeat(keep: bool):
    def run(m: Machine, body: p.Node, times: p.Node) -> Any:
        out = []
        try:
            for k in range(int(number(m.value(times)))):
                out.append(_body(m, body, float(k), float(k)))
        except BreakSignal:
            pass
        return out if keep else None

    return run


def _catch(m: Machine, body: p.Node) -> Any:
    try:
        value = m.value(body)
    except (Failure, ReturnSignal):
        return None
    return None if isinstance(value, ErrorValue) else value.data if isinstance(value, Result) else value


def _unwrap(m: Machine, body: p.Node) -> Any:
    value = m.value(body)
    if isinstance(value, Result):
        if value.err is not None:
            raise Failure(string_of(value.err))
        return value.data
    return value


def _recover(wrap: bool, stack: bool):
    def run(m: Machine, body: p.Node) -> Any:
        try:
            value = m.value(body)
        except Failure as e:
            return Result(str(e), traceback.format_exc() if stack else None)
        return Result(None, value) if wrap else value

    return run


def _defer(m: Machine, body: p.Node, last: p.Node) -> Any:
    try:
        return m.value(body)
    finally:
        m.value(last)


def _set_to(m: Machine, value: p.Node, name: p.Node) -> Any:
    m.vars[name.name if isinstance(name, p.Name) else string_of(m.value(name))] = out = m.value(value)
    return out


def _cost(m: Machine, body: p.Node) -> Any:
    start = time.perf_counter()
    m.value(body)
    return (time.perf_counter() - start) * 1000


def _if(m: Machine, *args: p.Node) -> Any:
    raise Failure("an if chain needs .end()")


def _and(m: Machine, *args: p.Node) -> Any:
    return all(condition(m.value(a)) for a in args)


def _go(m: Machine, body: p.Node) -> Any:
    fork = m.fork()
    return Result(None, fork.run(body.body if isinstance(body, p.Lambda) else body))


def _benchmark(m: Machine, body: p.Node, *times: p.Node) -> Any:
    n = int(number(m.value(times[0]))) if times else 1000
    start = time.perf_counter()
    for _ in range(n):
        m.value(body)
    return {"n": float(n), "ns": (time.perf_counter() - start) / max(1, n) * 1e9}


SPECIAL: dict[str, Callable] = {
    "ternary": _ternary, "for": _for, "all": _all, "loop": _loop, "repeat": _repeat(True), "repeats": _repeat(False),
    "catch": _catch, "unwrap": _unwrap, "recover": _recover(False, False), "recoverd": _recover(True, False), "recovers": _recover(False, True),
    "defer": _defer, "set_to": _set_to, "seto": _set_to, "cost": _cost, "benchmark": _benchmark, "if": _if, "switch": _if, "and": _and, "go": _go,
}

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
