"""Plans: what a document costs once is not asked for again."""

import json

from pyspark.sql import functions as F

from docloom.operators.rules import Rule
from docloom.operators.validate import Validator
from docloom.queries import QUERIES

SPEC = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"type": "string", "enum": ["x", "y"]}, "c": {"maxLength": 2}}, "required": ["a", "b"]}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def parses(df):
    return plan(df).count("parsejson(") + plan(df).count("parse_json(")


def documents(spark):
    rows = [(k, json.dumps({"a": k, "b": "xyz"[k % 3], "c": "q" * k})) for k in range(6)] + [(6, "not json"), (7, None)]
    return spark.createDataFrame(rows, "id long, doc string")


def test_a_filter_on_errors_parses_once(spark):
    done = Validator(SPEC).apply(documents(spark), "doc")
    errors = done.select("id", F.explode_outer("errors").alias("e")).where("e IS NOT NULL")
    found = Validator(SPEC)
    assert parses(done) == parses(errors) == parses(done.where("valid")) == parses(found.valid(documents(spark), "doc")) == 1
    assert errors.count() == sum(len(found.check(r.doc)[1]) for r in documents(spark).collect())
    assert {r.id for r in done.where("valid").collect()} == {r.id for r in found.valid(documents(spark), "doc").collect()}
    # an inner explode, which the optimizer gives a filter of its own
    assert parses(done.select("id", F.explode("errors").alias("e"))) == 1


def test_columns_not_asked_for_are_not_made(spark):
    done = Validator(SPEC).apply(documents(spark), "doc").select("id", "valid")
    assert "length must be" not in plan(done) and "value must be larger" not in plan(done)


def test_queries_parse_once(spark, tmp_path):
    spark.createDataFrame([(1, "click", 2.5, 7)], "event_id long, event_type string, value double, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert parses(QUERIES["v_type_required"](spark, str(tmp_path))) == parses(QUERIES["flagship"](spark, str(tmp_path))) == 1


def test_matches_are_found_once_for_a_text(spark):
    df = spark.createDataFrame([("singing of 12 kings, walking",), ("none",), (None,), ("ring",)], "s string").coalesce(1)
    rows, first = (df.select(Rule(text).column(df).alias("v")) for text in (r"regfind('([a-z]+)(ing)\\b', s)", r"regfind('([a-z]+)(ing)\\b', s)[0][1] or 'none'"))
    assert "regexp_extract_all" not in plan(rows).split("lambdafunction(", 1)[1]  # there it is computed for each match
    assert plan(first).count("regexp_extract_all(") == 1
    assert [r.v for r in rows.collect()] == [[["singing", "sing", "ing"], ["walking", "walk", "ing"]], [], [], [["ring", "r", "ing"]]]
    assert [r.v for r in first.collect()] == ["sing", "none", "none", "r"]


def test_other_parts_of_a_match(spark):
    df = spark.createDataFrame([("a1 b2",), ("",)], "s string").coalesce(1)
    for text, want in (("regfind('([a-z])([0-9])', s)[1]", [["b2", "b", "2"], None]), ("regfind('([a-z])([0-9])', s)[1][2]", ["2", None]), ("regfind('([a-z])([0-9])', s)[1][7]", [None, None]),
                       ("regfind('[a-z]', s)[1][0]", ["b", None]), ("regfind('[a-z]', s).len()", [2.0, 0.0]), ("regfind('[a-z]', s)[7] or s.split(' ')", [["a1", "b2"], [""]])):
        assert [r.v for r in df.select(Rule(text).column(df).alias("v")).collect()] == want, text


def test_maps_are_made_once(spark):
    """What stands in a lambda is computed for each key: no document is parsed there."""
    rows = [('{"k": 1, "b": "x", "a": [1, {"z": null}], "n": null, "d": -2.50, "t": true, "big": 1e30}', "v"), ("{}", None), ("[1]", "v"), ("no json", "v"), (None, "v"), ('"{}"', "v"), ("null", "v")]
    df = spark.createDataFrame(rows, "j string, s string").coalesce(1)
    programs = {"text": "to_json_obj(j).merge({t: s}).to_string('=', '&')", "two": "to_json_obj(j).merge(to_json_obj(j)).keys()", "same": "to_json_obj(j).exclude('k').merge(to_json_obj(j)).equals(to_json_obj(j))"}
    done = df.select(*(Rule(text).column(df).alias(name) for name, text in programs.items()))
    for name, parsed in (("text", 1), ("two", 2), ("same", 3)):
        assert plan(done.select(name)).count("parsejson(") + plan(done.select(name)).count("parse_json(") == parsed, name
    got = done.collect()
    assert got[0].text == "a=[1,{\"z\":null}]&b=x&big=1000000000000000000000000000000&d=-2.5&k=1&n=&t=v" and got[1].text == "t="
    assert got[0].two == ["a", "b", "big", "d", "k", "n", "t"] and got[1].two == []
    assert [r.same for r in got[:2]] == [True, True] and [r.text for r in got[2:]] == [None] * 5


def test_keys_of_the_row_are_made_once(spark):
    rows = [("click", 2.5, 7), ("n_7", None, 7), ("value", 1.0, 0), (None, 1e30, None)]
    df = spark.createDataFrame(rows, "kind string, value double, m long").coalesce(1).select("m", F.struct("kind", "value", "m").alias("doc"))
    spec = Validator({"setExpr": {"${kind}": "${value}", "n_${m}": "${m}"}, "setMap": {"gone": 1}, "del": {"gone": "", "${m}": ""}, "delete": ["kind", "m"]})
    done = spec.apply(df, "doc")
    assert plan(done).count("schema_of_variant(") + plan(done).count("schemaofvariant(") <= 4  # once for each template that is written as text
    for row, got in zip(rows, done.select(F.to_json("doc")).collect(), strict=True):
        assert json.loads(got[0]) == spec.check(dict(zip(("kind", "value", "m"), row, strict=True)))[0]
