"""Lexer and precedence-climbing parser of the rule language, and its JSON statement forms."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any


class RuleError(ValueError):
    """A program that does not parse."""


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Interp(Node):
    parts: tuple


@dataclass(frozen=True)
class Bin(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    of: Node


@dataclass(frozen=True)
class Ternary(Node):
    test: Node
    yes: Node
    no: Node


@dataclass(frozen=True)
class Assign(Node):
    target: Node
    value: Node


@dataclass(frozen=True)
class AddAssign(Node):
    target: Node
    value: Node


@dataclass(frozen=True)
class Bump(Node):
    target: Node
    by: float


@dataclass(frozen=True)
class As(Node):
    value: Node
    name: str


@dataclass(frozen=True)
class Seq(Node):
    items: tuple


@dataclass(frozen=True)
class Field(Node):
    of: Node
    name: str


@dataclass(frozen=True)
class Method(Node):
    of: Node
    name: str
    args: tuple


@dataclass(frozen=True)
class At(Node):
    of: Node
    index: Node


@dataclass(frozen=True)
class Slice(Node):
    of: Node
    start: Node | None
    end: Node | None


@dataclass(frozen=True)
class ArrayLit(Node):
    items: tuple


@dataclass(frozen=True)
class MapLit(Node):
    items: tuple


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple
    body: Node


@dataclass(frozen=True)
class Spread(Node):
    of: Node


@dataclass(frozen=True)
class Must(Node):
    of: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple


@dataclass(frozen=True)
class IfChain(Node):
    branches: tuple  # (condition, body)
    other: Node | None


@dataclass(frozen=True)
class SwitchChain(Node):
    subject: Node
    cases: tuple
    other: Node | None


@dataclass(frozen=True)
class For(Node):
    key: str | None
    value: str
    over: Node
    body: Node


@dataclass(frozen=True)
class Break(Node):
    pass


@dataclass(frozen=True)
class Return(Node):
    values: tuple = ()


@dataclass(frozen=True)
class Discard(Node):
    pass


NIL = Lit(None)

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d[\d_]*)(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_$\u0080-￿][A-Za-z0-9_$\u0080-￿]*)
    |(?P<op>\.\.\.|=>|\+\+|--|\+=|==|!=|<=|>=|&&|\|\||!!|\?\?|::|->|[-+*/%^&|!<>=?:;,.(){}\[\]@])""",
    re.X,
)
#: Operators from loose to tight; all left-associative.
LEVELS = (("or",), ("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+=",), ("+", "-"), ("*", "/"), ("%",), ("&", "|"))
ACCESS = (".", "::", "->")
WORDS = {"true": True, "false": False, "nil": None}
STATEMENTS: dict[str, Any] = {}


@dataclass
class Token:
    kind: str
    text: str
    value: Any = None
    start: int = 0


def tokens_of(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        if text[at] in "'\"`":
            node, at = _string(text, at)
            out.append(Token("string", "", node, at))
            continue
        m = TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected {text[at]!r} at {at} in {text!r}")
        if m.lastgroup == "number" and out and out[-1].text in ACCESS:
            out.append(Token("name", m.group(), None, at))
        elif m.lastgroup == "number":
            out.append(Token("number", m.group(), _number(m.group()), at))
        elif m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), None, at))
        at = m.end()
    return [*out, Token("end", "", None, at)]


def _number(text: str) -> float:
    digits = text.replace("_", "")
    if digits.lower().startswith("0x"):
        return float(int(digits, 16))
    if re.fullmatch(r"0[0-7]+", digits):
        return float(int(digits, 8))
    return float(digits)


# Escapes in strings.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _string(text: str, at: int) -> tuple[Node, int]:
    quote, at = text[at], at + 1
    parts: list = []
    held: list[str] = []
    while True:
        if at >= len(text):
            raise RuleError(f"unclosed string in {text!r}")
        c = text[at]
        if c == quote:
            break
        if c == "\\" and at + 1 < len(text):
            held.append(ESCAPES.get(text[at + 1], text[at + 1]))
            at += 2
            continue
        if c == "$" and text[at + 1 : at + 2] == "{":
            depth, end = 1, at + 2
            while end < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            if depth:
                raise RuleError(f"unclosed ${{ in {text!r}")
            if held:
                parts.append("".join(held))
                held = []
            parts.append(parse(text[at + 2 : end - 1]))
            at = end
            continue
        held.append(c)
        at += 1
    if held or not parts:
        parts.append("".join(held))
    node = Lit(parts[0]) if len(parts) == 1 and isinstance(parts[0], str) else Interp(tuple(parts))
    return node, at + 1


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens_of(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def take(self, text: str | None = None) -> Token:
        token = self.now
        if text is not None and token.text != text or token.kind == "string" and text is not None:
            raise RuleError(f"expected {text!r} at {token.start} in {self.text!r}")
        self.at += 1
        return token

    def when(self, *texts: str) -> bool:
        return self.now.kind != "string" and self.now.text in texts and self.now.kind != "end"

    def program(self) -> Node:
        node = self.sequence()
        if self.now.kind != "end":
            raise RuleError(f"unexpected {self.now.text!r} at {self.now.start} in {self.text!r}")
        return node

    def sequence(self) -> Node:
        items = [] if self.when(";") else [self.binding()]
        while self.when(";"):
            self.take()
            if self.now.kind == "end" or self.when(")", "}", "]"):
                break
            items.append(self.binding())
        return items[0] if len(items) == 1 else Seq(tuple(items))

    def _lambda(self) -> Node | None:
        if self.now.kind == "name" and self.peek().text == "=>" and self.peek().kind == "op":
            params = (self.take().text,)
        elif self.when("{"):
            k, params = 1, []
            while self.peek(k).kind == "name":
                params.append(self.peek(k).text)
                k += 1
                if self.peek(k).text == ",":
                    k += 1
            if self.peek(k).text != "}" or self.peek(k + 1).text != "=>":
                return None
            self.at += k + 1
        else:
            return None
        self.take("=>")
        return Lambda(tuple(params), self.binding())

    def binding(self) -> Node:
        found = self._lambda()
        if found:
            return found
        node = self.assignment()
        while self.when("as"):
            self.take()
            node = As(node, self.take().text)
        return node

    def assignment(self) -> Node:
        left = self.ternary()
        if self.when("="):
            self.take()
            right = self._lambda() or self.assignment()
            return Assign(left, right)
        return left

    def ternary(self) -> Node:
        test = self.level(0)
        if self.when("?"):
            self.take()
            yes = self.ternary()
            self.take(":")
            return Ternary(test, yes, self.ternary())
        return test

    def level(self, k: int) -> Node:
        if k == len(LEVELS):
            return self.negation()
        left = self.level(k + 1)
        while self.when(*LEVELS[k]):
            op = self.take().text
            right = self._lambda() or self.level(k + 1)
            left = AddAssign(left, right) if op == "+=" else Bin(op, left, right)
        return left

    def negation(self) -> Node:
        if self.when("!"):
            self.take()
            return Unary("!", self.negation())
        left = self.postfix()
        while self.when("^"):
            self.take()
            left = Bin("^", left, self.postfix())
        return left

    def postfix(self) -> Node:
        if self.when("const") and self.peek().text not in (")", ",", ";", "=", ""):
            self.take()
            return self.postfix()
        if self.when("const") and (self.peek().kind in ("string", "number")):
            self.take()
            return self.postfix()
        if self.when("-"):
            self.take()
            return Unary("-", self.postfix())
        node = self.primary()
        while True:
            if self.when(*ACCESS):
                self.take()
                name = self.take()
                if name.kind not in ("name", "string"):
                    raise RuleError(f"expected a name at {name.start} in {self.text!r}")
                text = name.text if name.kind == "name" else name.value.value
                node = Method(node, text, self.arguments()) if self.when("(") else Field(node, text)
            elif self.when("["):
                self.take()
                start = None if self.when(":") else self.binding()
                if self.when(":"):
                    self.take()
                    end = None if self.when("]") else self.binding()
                    self.take("]")
                    node = Slice(node, start, end)
                else:
                    self.take("]")
                    node = At(node, start)
            elif self.when("!!", "@", "??"):
                self.take()
                node = Must(node)
            elif self.when("++", "--"):
                node = Bump(node, 1.0 if self.take().text == "++" else -1.0)
            elif self.when("..."):
                self.take()
                node = Spread(node)
            else:
                return fold_chain(node)

    def arguments(self) -> tuple:
        self.take("(")
        out = []
        while not self.when(")"):
            out.append(self.sequence())
            if not self.when(")"):
                self.take(",")
        self.take(")")
        return tuple(out)

    def primary(self) -> Node:
        token = self.now
        if token.kind in ("string", "number"):
            self.take()
            return token.value if token.kind == "string" else Lit(token.value)
        if token.kind == "name":
            self.take()
            if self.when("("):
                return Call(token.text, self.arguments())
            if token.text in WORDS:
                return Lit(WORDS[token.text])
            if token.text == "break":
                return Break()
            return Discard() if token.text == "_" else Name(token.text)
        if self.when("("):
            self.take()
            node = self.sequence()
            self.take(")")
            return node
        if self.when("["):
            self.take()
            items = []
            while not self.when("]"):
                items.append(self.binding())
                if not self.when("]"):
                    self.take(",")
            self.take("]")
            return ArrayLit(tuple(items))
        if self.when("{"):
            return self.map_literal()
        raise RuleError(f"unexpected {token.text or 'end'!r} at {token.start} in {self.text!r}")

    def map_literal(self) -> Node:
        self.take("{")
        items = []
        while not self.when("}"):
            if self.now.kind == "name" and self.peek().text == ":" and self.peek().kind == "op":
                key: Node = Lit(self.take().text)
            else:
                key = self.level(0)
            self.take(":")
            items.append((key, self.binding()))
            if not self.when("}"):
                self.take(",")
        self.take("}")
        return MapLit(tuple(items))


def fold_chain(node: Node) -> Node:
    """if(..).then(..).elseif(..).else(..).end() and switch(..).case(..).default(..).end() as one node."""
    if not (isinstance(node, Method) and node.name == "end" and not node.args):
        return node
    calls, base = [], node.of
    while isinstance(base, Method):
        calls.append((base.name, base.args))
        base = base.of
    if not (isinstance(base, Call) and base.name in ("if", "switch")):
        return node
    calls.reverse()
    body = lambda args: NIL if not args else args[0] if len(args) == 1 else Seq(tuple(args))
    if base.name == "switch":
        if not all(n in ("case", "default") for n, _ in calls):
            raise RuleError(f"unexpected call in a switch chain: {[n for n, _ in calls]}")
        return SwitchChain(base.args[0], tuple((a[0], body(a[1:])) for n, a in calls if n == "case"), next((body(a) for n, a in calls if n == "default"), None))
    branches, other = [[base.args[0], body(base.args[1:])]], None
    for name, args in calls:
        if name == "then":
            branches[-1][1] = body(args)
        elif name == "elseif":
            branches.append([args[0], body(args[1:])])
        elif name == "else":
            other = body(args)
        else:
            raise RuleError(f"unexpected {name!r} in an if chain")
    return IfChain(tuple(map(tuple, branches)), other)


def parse(text: str) -> Node:
    """One expression, or several with `;`."""
    return Parser(text).program() if text.strip() else NIL


def register_statement(name: str, make) -> None:
    """Add a JSON statement form: make(object, parse_program) -> Node."""
    STATEMENTS[name] = make


def parse_program(value: Any) -> Node:
    """A program in JSON: arrays of statements, statement objects, expression strings."""
    if isinstance(value, list):
        items: list[Node] = []
        for v in value:
            node = parse_program(v)
            items += node.items if isinstance(node, Seq) else [node]
        return Seq(tuple(items))
    if isinstance(value, str):
        text = value.strip()
        if text == "break":
            return Break()
        if text == "return":
            return Return()
        return NIL if text.startswith("#") else parse(text)
    if isinstance(value, dict):
        for name, make in STATEMENTS.items():
            if name in value:
                return make(value, parse_program)
        if "if" in value:
            other = parse_program(value["else"]) if "else" in value else None
            return IfChain(((parse_program(value["if"]), parse_program(value.get("then", []))),), other)
        if "for" in value:
            m = re.fullmatch(r"\s*(?:([\w$]+)\s*,\s*)?([\w$]+)\s+in\s+(.+)", value["for"], re.S)
            if not m:
                raise RuleError(f"bad for: {value['for']!r}")
            return For(m[1], m[2], parse(m[3]), parse_program(value.get("do", [])))
        if "switch" in value:
            other = parse_program(value["default"]) if "default" in value else None
            subject = value["switch"]
            if isinstance(subject, dict):
                return IfChain(tuple((parse(k), parse_program(v)) for k, v in subject.items()), other)
            cases = tuple((Lit(k), parse_program(v)) for k, v in value.get("case", {}).items())
            return SwitchChain(parse(subject), tuple((_case(c), b) for c, b in cases), other)
    raise RuleError(f"not a statement: {value!r}")


def _case(key: Lit) -> Node:
    try:
        node = parse(key.value)
    except RuleError:
        return key
    return node if isinstance(node, Lit) else key


def parse_text(text: str) -> Node:
    """A program given as text: JSON statements, or an expression."""
    stripped = text.strip()
    if stripped[:1] in "[{":
        try:
            return parse_program(json.loads(stripped, parse_int=float))
        except ValueError:
            pass
    return parse(text)


__all__ = [n for n in dir() if n[0].isupper()] + ["fold_chain", "field", "parse", "parse_program", "parse_text", "register_statement"]
