"""What the rule language knows by name: functions, methods by kind of value, and the host objects."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from docloom.functions.values import rule_number_of


class Failure(Exception):
    """A rule error, as a value it is `ErrorValue`."""


@dataclass
class Entry:
    run: Callable
    least: int = 0
    most: int | None = None

    def check(self, name: str, n: int) -> None:
        if n < self.least or (self.most is not None and n > self.most):
            raise Failure(f"{name} takes {self.least}{'' if self.most == self.least else f' to {self.most}'} arguments, not {n}")


FUNCTIONS: dict[str, Entry] = {}
METHODS: dict[str, dict[str, Callable]] = {k: {} for k in ("string", "array", "map", "bytes", "number", "boolean", "time", "builder", "regexp", "url", "atomic")}
#: Functions that any value has as a method.
FOR_ALL: set[str] = {"catch", "unwrap", "recover", "recoverd", "recovers", "for", "repeat", "repeats", "defer", "set_to", "seto", "cost", "go", "string", "number", "bool", "boolean", "type", "is_empty", "to_json_str", "print", "benchmark"}


def register_function(name: str, run: Callable, least: int = 0, most: int | None = None) -> None:
    """Add run(machine, *args); a name must not contain a dot."""
    if "." in name:
        raise ValueError(f"a function name must not contain a dot: {name!r}")
    FUNCTIONS[name] = Entry(run, least, most)


def register_method(kind: str, name: str, run: Callable) -> None:
    """Add run(machine, self, *args) to a kind of value, or to every kind with "*"."""
    if kind == "*":
        FOR_ALL.add(name)
        FUNCTIONS[name] = Entry(run)
    else:
        METHODS.setdefault(kind, {})[name] = run


def kind_of(value: Any) -> str:
    for kind, types in (("boolean", bool), ("string", str), ("number", (int, float)), ("array", list), ("url", UrlValues), ("map", dict), ("bytes", bytes), ("time", dt.datetime), ("builder", Builder), ("regexp", re.Pattern), ("atomic", Atomic)):
        if isinstance(value, types):
            return kind
    return "nil" if value is None else type(value).__name__


def method_of(value: Any, name: str) -> Callable | None:
    found = METHODS.get(kind_of(value), {}).get(name)
    if found is None and name in FOR_ALL and name in FUNCTIONS:
        return FUNCTIONS[name].run
    return found


class Builder:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def __str__(self) -> str:
        return "".join(self.parts)


class UrlValues(dict):
    pass


class Atomic:
    def __init__(self, n: Any = 0.0) -> None:
        self.value = rule_number_of(n)
