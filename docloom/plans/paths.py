r"""Paths into documents: dotted keys, [n] indexes, `\` escapes, `${k}` indirect keys."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from docloom.functions.values import ABSENT, string_of


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Indirect:
    """A key named by another key's value in the same object."""

    name: str


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Path:
    text: str
    steps: tuple[Key | Index | Indirect, ...]

    def get(self, value: Any) -> Any:
        """The value there, or ABSENT."""
        for step in self.steps:
            if isinstance(step, Index):
                if not isinstance(value, list) or not 0 <= step.at < len(value):
                    return ABSENT
                value = value[step.at]
                continue
            if not isinstance(value, dict):
                return ABSENT
            name = step.name if isinstance(step, Key) else string_of(value.get(step.name))
            if name not in value:
                return ABSENT
            value = value[name]
        return value

    def set(self, root: Any, value: Any) -> Any:
        """Write, making objects and arrays on the way; -1 appends. Returns the root."""
        return _set(root, self.steps, value)

    @property
    def static(self) -> bool:
        return not any(isinstance(s, Indirect) for s in self.steps)


def _set(node: Any, steps: tuple, value: Any) -> Any:
    if not steps:
        return value
    step, rest = steps[0], steps[1:]
    if isinstance(step, Index):
        if not isinstance(node, list):
            node = []
        at = step.at
        if at == -1:
            node.append(_set(None, rest, value))
            return node
        if at < 0:
            return node
        node.extend([None] * (at + 1 - len(node)))
        node[at] = _set(node[at], rest, value)
        return node
    if not isinstance(node, dict):
        if isinstance(node, list):  # a name does not apply to an array
            return node
        node = {}
    name = step.name if isinstance(step, Key) else string_of(node.get(step.name))
    node[name] = _set(node.get(name), rest, value)
    return node


def parse_path(text: str) -> Path:
    steps: list = []
    name, at, any_name = [], 0, False
    after_index = False
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            name.append(text[at + 1])
            any_name, at, after_index = True, at + 2, False
            continue
        if c == "$" and text[at + 1 : at + 2] == "{" and not name:
            end = text.find("}", at)
            if end < 0:
                raise PathError(f"unclosed ${{ in path {text!r}")
            steps.append(Indirect(text[at + 2 : end]))
            at, after_index = end + 1, True
            continue
        if c == ".":
            if not after_index:
                steps.append(Key("".join(name)))
            name, any_name, after_index = [], False, False
            at += 1
            if text[at : at + 1] == "[":
                after_index = True
            continue
        if c == "[":
            end = text.find("]", at)
            try:
                index = int(text[at + 1 : end]) if end > 0 else None
            except ValueError:
                index = None
            if index is None:
                raise PathError(f"bad index in path {text!r}")
            if name or any_name:
                steps.append(Key("".join(name)))
            name, any_name = [], False
            steps.append(Index(index))
            at, after_index = end + 1, True
            continue
        name.append(c)
        any_name, after_index = True, False
        at += 1
    if name or any_name or not after_index:
        steps.append(Key("".join(name)))
    return Path(text, tuple(steps))
