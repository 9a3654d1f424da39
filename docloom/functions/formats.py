r"""String formats: a Python predicate for the interpreter and, where one exists, a Column.

A Column form is an exact or, for e-mail addresses, a close equivalent of the Python one.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from collections.abc import Callable
from email.utils import parseaddr
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_TIME = r"([01]\d|2[0-3]):([0-5]\d):([0-5]\d)([.,]\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)"
# Patterns of the formats.
HOSTNAME = r"^([a-zA-Z0-9]{1}[a-zA-Z0-9_-]{0,62}){1}(\.[a-zA-Z0-9_]{1}[a-zA-Z0-9_-]{0,62})*?$"
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
EMAIL = r"^\s*([^<>@]*<)?[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+>?\s*$"
IDN_DENIED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r。．｡"
URI_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _real_date(text: str) -> bool:
    try:
        dt.date.fromisoformat(text[:10])
    except ValueError:
        return False
    return True


def is_date(text: str) -> bool:
    return bool(re.fullmatch(_DATE, text)) and _real_date(text)


def is_time(text: str) -> bool:
    return bool(re.fullmatch(_TIME, text))


def is_date_time(text: str) -> bool:
    return bool(re.fullmatch(f"{_DATE}T{_TIME}", text)) and _real_date(text)


def is_email(text: str) -> bool:
    _, address = parseaddr(text)
    user, at, host = address.rpartition("@")
    return bool(at and user and host) and bool(re.search(EMAIL, text))


def is_hostname(text: str) -> bool:
    return len(text.encode()) <= 255 and bool(re.search(HOSTNAME, text))


def is_idn_hostname(text: str) -> bool:
    return len(text.encode()) <= 255 and not any(c in IDN_DENIED for c in text)


def _is_ip(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return "%" not in text


def is_ipv4(text: str) -> bool:
    return "." in text and _is_ip(text)


def is_ipv6(text: str) -> bool:
    return ":" in text and _is_ip(text)


def is_uri_reference(text: str) -> bool:
    if "\\" in text or re.search(r"[\x00-\x1f\x7f]", text) or re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return False
    first = re.split(r"[/?#]", text, maxsplit=1)[0]
    if first.startswith(":") or (":" in first and not re.match(URI_SCHEME, text)):
        return False
    try:
        parts = urlsplit(text)
        parts.port
    except ValueError:
        return False
    return " " not in parts.netloc


def is_uri(text: str) -> bool:
    return bool(re.match(URI_SCHEME, text)) and is_uri_reference(text.replace("\\", "/"))


def is_uri_template(text: str) -> bool:
    filled = re.sub(r"\{[^{}\\]*\}", "aaa", text)
    return "{" not in filled and "}" not in filled and is_uri_reference(filled)


def is_json_pointer(text: str) -> bool:
    return bool(re.fullmatch(r"(/([^~]|~[01])*)?", text, re.S))


def is_relative_json_pointer(text: str) -> bool:
    return bool(re.fullmatch(r"(0|[1-9][0-9]*)(#|(/([^~]|~[01])*)?)", text, re.S))


def is_regex(text: str) -> bool:
    if re.search(r"\(\?[=!<][=!]?(?!\w+>)|\\[1-9]", text):
        return False
    try:
        re.compile(text)
    except re.error:
        return False
    return True


def is_phone(text: str) -> bool:
    return len(text.encode()) == 11 and text.startswith("1")


_to_date = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
_short = lambda c: F.octet_length(c) <= 255


def _reference(c: Column) -> Column:
    first = F.regexp_extract(c, r"^[^/?#]*", 0)
    bad = c.rlike(r"[\\\x00-\x1f\x7f]") | c.rlike(r"%(?![0-9A-Fa-f]{2})") | first.startswith(":") | (first.contains(":") & ~c.rlike(URI_SCHEME))
    host = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return ~bad & ~host.contains(" ") & ~host.rlike(r"^[^\[]*:[^\[\]]*[^0-9\[\]][^\[\]@]*$")


def _address6(c: Column) -> Column:
    """An IPv6 address: eight groups, or fewer around one `::`; the last two may be an IPv4 address."""
    tail = F.regexp_extract(c, r"[^:]*\.[^:]*$", 0)
    body = F.when(tail.rlike(IPV4), F.concat(F.regexp_replace(c, r"[^:]*\.[^:]*$", ""), F.lit("0:0"))).otherwise(c)
    groups = F.split(body, ":", -1)
    filled = F.filter(groups, lambda x: x != "")
    plain = body.rlike(r"^[0-9A-Fa-f:]+\z") & F.forall(filled, lambda x: F.length(x) <= 4)
    whole = (F.size(groups) == 8) & (F.size(filled) == 8)
    short = body.contains("::") & ~body.rlike(r":::|::.*::|^:[^:]|[^:]:\z") & (F.size(filled) <= 7)
    return plain & (whole | short)


#: Name -> (Python predicate, Column predicate or None, message).
FORMATS: dict[str, tuple[Callable[[str], bool], Callable[[Column], Column] | None]] = {
    "date-time": (is_date_time, lambda c: c.rlike(f"^{_DATE}T{_TIME}\\z") & _to_date(c)),
    "date": (is_date, lambda c: c.rlike(f"^{_DATE}\\z") & _to_date(c)),
    "time": (is_time, lambda c: c.rlike(f"^{_TIME}\\z")),
    "email": (is_email, lambda c: c.rlike(EMAIL)),
    "idn-email": (is_email, lambda c: c.rlike(EMAIL)),
    "hostname": (is_hostname, lambda c: c.rlike(HOSTNAME) & _short(c)),
    "idn-hostname": (is_idn_hostname, lambda c: _short(c) & (F.translate(c, IDN_DENIED, "") == c)),
    "ipv4": (is_ipv4, lambda c: c.rlike(IPV4) | (c.contains(".") & c.contains(":") & _address6(c))),
    "ipv6": (is_ipv6, lambda c: c.contains(":") & _address6(c)),
    "uri": (is_uri, lambda c: c.rlike(URI_SCHEME) & _reference(F.translate(c, "\\", "/"))),
    "iri": (is_uri, lambda c: c.rlike(URI_SCHEME) & _reference(F.translate(c, "\\", "/"))),
    "uri-reference": (is_uri_reference, _reference),
    "iri-reference": (is_uri_reference, _reference),
    "uri-template": (is_uri_template, lambda c: (lambda f: ~f.rlike(r"[{}]") & _reference(f))(F.regexp_replace(c, r"\{[^{}\\]*\}", "aaa"))),
    "json-pointer": (is_json_pointer, lambda c: c.rlike(r"(?s)^(/([^~]|~[01])*)?\z")),
    "relative-json-pointer": (is_relative_json_pointer, lambda c: c.rlike(r"(?s)^(0|[1-9][0-9]*)(#|(/([^~]|~[01])*)?)\z")),
    "regex": (is_regex, None),
    "phone": (is_phone, lambda c: (F.octet_length(c) == 11) & c.startswith("1")),
}


def udf_of(test: Callable[[str], bool]) -> Callable[[Column], Column]:
    """An Arrow-batched predicate for a format that has no Column form."""
    import pandas as pd

    def run(values):
        return values.map(lambda x: None if x is None else bool(test(x)))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def column_of(name: str) -> Callable[[Column], Column]:
    test, column = FORMATS[name]
    return column or udf_of(test)


def add_format(name: str, test: Callable[[str], bool], column: Callable[[Column], Column] | None = None) -> None:
    """Register a format; without a Column form it runs as an Arrow-batched predicate."""
    FORMATS[name] = test, column
