import pytest

from docloom.functions import formats, gotime
from docloom.functions.values import ABSENT, Flags, compare, condition, format_float, print_value, root_bool_of, root_equal, root_number_of, rule_bool_of, rule_number_of, strict_equal, string_of
from docloom.plans.paths import Index, Key, PathError, parse_path


def test_texts_of_values():
    assert [string_of(x) for x in ("a", 30.0, 1.5, True, None, 1e21)] == ["a", "30", "1.5", "true", "", "1000000000000000000000"]
    assert format_float(1e-7) == "0.0000001"
    assert print_value({"b": [1.0, "x"], "a": None}) == "map[a:<nil> b:[1 x]]"
    assert print_value(1e21) == "1e+21"


def test_two_sets_of_coercions():
    assert root_number_of("12") == 12 and root_number_of("12", Flags(strict=True)) == 0
    assert rule_number_of("true") == 1 and root_number_of("true") == 0
    assert root_bool_of(-1.0) is False and rule_bool_of(-1.0) is True
    assert root_bool_of("yes") is False and rule_bool_of("yes") is True
    assert condition(0.0) and condition("") and not condition(None) and not condition(False)


def test_equalities_and_order():
    assert root_equal("1", 1.0) and root_equal(5.0, "5") and root_equal(True, "true")
    assert not strict_equal("1", 1.0) and strict_equal(1.0, 1.0) and not strict_equal(True, 1.0)
    assert compare(1.0, "2") == -1 and compare("b", "a") == 1 and compare([], 1.0) == 0


def test_paths_read():
    doc = {"arr": [1.0, ["arr11"]], "c": {"name": "ase", "ase": {"dd": 5.0}}, "a.b": 1.0}
    assert parse_path("arr[1][0]").get(doc) == "arr11"
    assert parse_path("arr[9]").get(doc) is ABSENT and parse_path("x.y").get(doc) is ABSENT
    assert parse_path(r"a\.b").get(doc) == 1.0
    assert parse_path("c.${name}.dd").get(doc) == 5.0
    assert parse_path(r"abb\.\.55.[4][5][6].aa\[5").steps == (Key("abb..55"), Index(4), Index(5), Index(6), Key("aa[5"))
    with pytest.raises(PathError):
        parse_path("a[x]")


def test_paths_write():
    doc: dict = {}
    parse_path("chd[1][3].name[0]").set(doc, "v")
    assert doc == {"chd": [None, [None, None, None, {"name": ["v"]}]]}
    ws: dict = {}
    for k in range(4):
        parse_path("ws[-1].cw[-1]").set(ws, k)
    assert ws == {"ws": [{"cw": [0]}, {"cw": [1]}, {"cw": [2]}, {"cw": [3]}]}
    assert parse_path("[0].user[0].a.b").set(None, 1) == [{"user": [{"a": {"b": 1}}]}]


CASES = {
    "date-time": ("2024-02-29T12:00:00Z", "2024-02-30T12:00:00Z"),
    "date": ("2024-02-29", "2023-02-29"),
    "time": ("23:59:59+01:00", "24:00:00Z"),
    "email": ("Bob <b@x.org>", "b.x.org"),
    "hostname": ("a-b.example", "-a"),
    "idn-hostname": ("例え", "a-b"),
    "ipv4": ("1.2.3.4", "256.1.1.1"),
    "ipv6": ("::1", "1.2.3.4"),
    "uri": ("http://a/b?c", "//a/b"),
    "uri-reference": ("/a/b", "a\\b"),
    "uri-template": ("/a/{b}", "/a/{b"),
    "json-pointer": ("/a/~0", "/a/~"),
    "relative-json-pointer": ("1/a", "-1/a"),
    "regex": ("a(b|c)+", "a(b"),
    "phone": ("13800000000", "23800000000"),
}


@pytest.mark.parametrize("name", CASES)
def test_formats(spark, name):
    good, bad = CASES[name]
    test = formats.FORMATS[name][0]
    assert test(good) and not test(bad)
    df = spark.createDataFrame([(good,), (bad,)], "x string")
    assert [r[0] for r in df.select(formats.column_of(name)(df.x)).collect()] == [True, False]


def test_times():
    t = gotime.parse_time("2006-01-02 15:04:05", "2025-01-02 12:10:20")
    assert (t.year, t.month, t.day, t.hour, t.minute, t.second) == (2025, 1, 2, 12, 10, 20)
    assert gotime.format_time(t, "02/01/2006 15:04") == "02/01/2025 12:10"
    assert gotime.spark_pattern("2006-01-02T15:04") == "yyyy-MM-dd'T'HH:mm"
    assert gotime.parse_duration("1h2m3.5s").total_seconds() == 3723.5 and gotime.parse_duration("5x") is None
