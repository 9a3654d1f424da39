"""Values of a document (the JSON kinds, every number a double) and how they are coerced.

Two rule sets exist: `root` for schemas and templates, `rule` for the rule language. This
module is the plain-Python side, which the interpreter and literals use; `columns.py` has
the same rules as Spark Columns.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any


@dataclass(frozen=True)
class Flags:
    """strict: reproduce observable quirks instead of the intended semantics."""

    strict: bool = False


ABSENT = object()
_NUMBER = re.compile(r"[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?0[xX][0-9a-fA-F]+|[+-]?(inf|infinity|nan)", re.I)


def plain(value: Any) -> Any:
    """A value as the JSON kinds: ints, decimals and numpy numbers become doubles."""
    if isinstance(value, (bool, str, float, bytes)) or value is None:
        return value
    if isinstance(value, (int, Decimal)):
        return float(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def parse_json(text: str) -> Any:
    return json.loads(text, parse_int=float)


def dump_json(value: Any) -> str:
    """Compact JSON with sorted keys; whole doubles print without a fraction."""
    return json.dumps(_jsonable(value), separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _jsonable(value: Any) -> Any:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, dict):
        return {k: _jsonable(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_jsonable(v) for v in value]
    if isinstance(value, bytes):
        import base64

        return base64.b64encode(value).decode()
    if isinstance(value, (str, bool, int, float)) or value is None:
        return value
    return str(value)


def format_float(x: float) -> str:
    """The shortest decimal text without an exponent."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    text = format(Decimal(repr(x)), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return text


def print_value(value: Any) -> str:
    """The default print form: map[k:v] sorted by key, [a b], exponents for large numbers."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isinf(value) or math.isnan(value):
            return format_float(value)
        exponent = int(math.floor(math.log10(abs(value)))) if value else 0
        if exponent < -4 or exponent >= 21:
            mantissa, _, power = repr(value).partition("e")
            if not power:
                mantissa, _, power = f"{value:.17g}".partition("e")
            if not power:
                digits = format_float(abs(value))
                whole = digits.replace(".", "").lstrip("0").rstrip("0")
                mantissa = ("-" if value < 0 else "") + whole[0] + ("." + whole[1:] if len(whole) > 1 else "")
                power = str(exponent)
            n = int(power)
            return f"{mantissa}e{'-' if n < 0 else '+'}{abs(n):02d}"
        return format_float(value)
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{print_value(v)}" for k, v in sorted(value.items())) + "]"
    if isinstance(value, list):
        return "[" + " ".join(map(print_value, value)) + "]"
    if isinstance(value, bytes):
        return "[" + " ".join(map(str, value)) + "]"
    return str(value)


def string_of(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return format_float(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return print_value(value)


def parse_number(text: str) -> float | None:
    if not _NUMBER.fullmatch(text):
        return None
    try:
        return float(int(text, 16)) if "x" in text.lower() else float(text)
    except (ValueError, OverflowError):
        return None


def root_number_of(value: Any, flags: Flags = Flags()) -> float:
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (float, int)):
        return float(value)
    if isinstance(value, str) and not flags.strict:
        return parse_number(value) or 0.0
    return 0.0


def root_bool_of(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, int)):
        return value > 0
    return value == "true"


def root_equal(a: Any, b: Any, flags: Flags = Flags()) -> bool:
    """Equality after coercion by the kind of the left side."""
    if isinstance(a, bool):
        return a == root_bool_of(b)
    if isinstance(a, (float, int)):
        return a == root_number_of(b, flags)
    return string_of(a) == string_of(b)


def rule_number_of(value: Any) -> float:
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (float, int)):
        return float(value)
    if isinstance(value, (str, bytes)):
        text = string_of(value)
        return 1.0 if text == "true" else parse_number(text) or 0.0
    return 0.0


def rule_bool_of(value: Any) -> bool:
    if value is None:
        return False
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, int)):
        return value != 0
    if isinstance(value, str):
        return value not in ("false", "0", "", "False", "FALSE")
    return True


def condition(value: Any) -> bool:
    """Only false and nil are false."""
    return value is not None and value is not False


def strict_equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    if isinstance(a, (dict, list)) or isinstance(b, (dict, list)):
        return False
    return type(a) is type(b) and a == b


def deep_equal(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    return strict_equal(a, b)


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1 by the kind of the left side; other kinds are equal to anything."""
    if isinstance(a, bool):
        return 0
    if isinstance(a, (float, int)):
        x, y = float(a), rule_number_of(b)
    elif isinstance(a, str):
        x, y = a.encode(), string_of(b).encode()
    else:
        return 0
    return (x > y) - (x < y)
