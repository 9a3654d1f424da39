"""Whole documents of a seed bank, a ferry line and a print shop: several keywords at once, results reasoned from their meaning."""

import pytest
from pyspark.sql import functions as F

from docloom.operators.validate import Validator


def errors_in(spec, document):
    return Validator(spec).check(document)[1]


def after(spec, document):
    out, errors = Validator(spec).check(document)
    assert not errors
    return out


PACKET = {"properties": {
    "lot": {"type": "integer|string", "minLength": 3, "replaceKey": "batch"},
    "tests": {"type": "array", "minItems": 3, "maxItems": 6, "uniqueItems": True, "items": {"type": "number", "minimum": 0, "maximum": 100}},
    "shelf": {"type": "string", "pattern": "^[A-D][0-9]+$"},
}}


@pytest.mark.parametrize("packet,want", [
    ({"lot": "L77", "tests": [91, 88, 90], "shelf": "B12"}, []),
    ({"lot": 5, "tests": [91, 91, 130], "shelf": "B12"}, [("$.tests", " items should be unique"), ("$.tests[*]", "value must be <= than 100")]),
    ({"lot": "x", "tests": [50], "shelf": "Z"}, [("$.lot", "length must be larger or equal than 3"), ("$.tests", " min length is 3"), ("$.shelf", "Z ,value does not match pattern: ^[A-D][0-9]+$")]),
])
def test_a_seed_packet(packet, want):
    assert sorted(errors_in(PACKET, packet)) == sorted(want)
    assert Validator(PACKET).check(packet)[0]["batch"] == packet["lot"]


def test_fare_by_kind_of_passenger():
    fare = {
        "switch": "kind", "case": {"vehicle": {"required": ["plate", "metres"]}, "foot": {"lte": {"bags": 2}}}, "defaults": {"error": "no fare for ${kind}"},
        "if": {"gt": {"metres": 6}}, "then": {"set": {"deck": "lower"}}, "else": {"set": {"deck": "upper"}},
    }
    assert after(fare, {"kind": "vehicle", "plate": "FE 12", "metres": 7.5})["deck"] == "lower"
    assert after(fare, {"kind": "foot", "bags": 1})["deck"] == "upper"
    assert errors_in(fare, {"kind": "vehicle", "metres": 4}) == [("$.plate", "field is required")]
    assert errors_in(fare, {"kind": "foot", "bags": 3}) == [("$.bags", "should less or equal  than 2")]
    assert errors_in(fare, {"kind": "bird"}) == [("$", "no fare for bird")]


def test_a_condition_is_closed_like_any_schema():
    """A field that the condition does not name makes it fail, so nothing is deleted."""
    spec = {"if": {"properties": {"draft": {"const": "yes"}}}, "then": {"delete": ["draft"]}}
    assert after(spec, {"draft": "yes"}) == {}
    assert after(spec, {"draft": "yes", "pages": 8}) == {"draft": "yes", "pages": 8.0}


def test_either_contact_will_do():
    spec = {"anyOf": [{"required": ["telephone"]}, {"required": ["post"]}]}
    assert errors_in(spec, {"post": "box 9"}) == [] and len(errors_in(spec, {"fax": 1})) == 2


def test_folders_within_folders():
    spec = {"properties": {"title": {"type": "string", "maxLength": 9}, "cover": {"$ref": "#/$defs/sheet"}, "inside": {"$ref": "#/"}}, "$defs": {"sheet": {"properties": {"gsm": {"multipleOf": 10}, "behind": {"$ref": "#/$defs/sheet"}}}}}
    folder = {"title": "spring", "cover": {"gsm": 90, "behind": {"gsm": 120}}, "inside": {"title": "inlay", "inside": {"title": "slip"}}}
    assert errors_in(spec, folder) == []
    folder["inside"]["inside"]["title"] = 4
    folder["cover"]["behind"]["gsm"] = 125
    assert {path for path, _ in errors_in(spec, folder)} == {"$.inside.inside.title", "$.cover.behind.gsm"}


def test_defaults_come_after_the_checks():
    spec = {"properties": {"copies": {"minimum": 1, "exclusiveMaximum": 500, "exclusiveMinimum": False}}, "defaultVals": {"ink": "black", "finish": {}}}
    assert after(spec, {"copies": 1}) == {"copies": 1.0, "ink": "black", "finish": {}}  # ink is no unknown field
    assert errors_in(spec, {"copies": 500, "ink": "red"}) == [("$.copies", "value should be < 500"), ("$.ink", "unknown field")]


def test_tides_of_any_harbour():
    spec = {"$defs": {"tide": {"properties": {"state": {"enums": ["ebb", "flood", "slack"]}, "metres": {"maximum": 9}}}}, "properties": {"port": {}, "tides": {"properties": {"home": {}}, "additionalProperties": {"$ref": "#/$defs/tide"}}}}
    tides = {"home": 1, "east": {"state": "ebb", "metres": 2}, "west": {"state": "high", "metres": 12}}
    assert {info for _, info in errors_in(spec, {"port": "H", "tides": tides})} == {"value is invalid , shoule be one of [ebb flood slack]", "value must be <= than 9"}


def test_a_job_ticket_is_rewritten_step_by_step():
    spec = [
        {"if": {"not": {"ipIn": {"press": ["192.168.7.0/24"]}}}, "then": {"error": "press ${press} is not ours"}},
        {"if": {"eq": {"rush": True}}, "then": {"set": {"marks[0]": "RUSH"}, "setExpr": {"for_${client}": "${press}"}}},
        {"foreach": {"sections": {"foreach": {"__val.leaves": {"set": {"order": "${order}${__val.side}"}}}}}},
        {"delete": ["sections", "rush"]},
    ]
    ticket = {"client": "ann", "press": "192.168.7.20", "rush": True, "sections": [{"leaves": [{"side": "A"}, {"side": "b"}]}, {"leaves": []}, {"leaves": [{"side": "C"}]}]}
    assert after(spec, ticket) == {"client": "ann", "press": "192.168.7.20", "marks": ["RUSH"], "for_ann": "192.168.7.20", "order": "AbC"}
    assert errors_in(spec, ticket | {"press": "192.168.8.1"}) == [("$", "press 192.168.8.1 is not ours")]


def test_checks_and_writes_run_in_columns(spark):
    """Mixed checks and writes, without Python on executors, as the interpreter has them."""
    crossing = Validator({
        "type": "object", "required": ["vessel"],
        "properties": {
            "vessel": {"type": "string", "maxLength": 12}, "knots": {"type": "number", "minimum": 0, "maximum": 40}, "crew": {"items": {"type": "string"}, "maxItems": 3}, "flag": {"constVal": "NO"},
            "log": {"properties": {"wind": {"type": "integer"}, "sea": {"type": "string", "default": "calm"}}},
        },
        "if": {"gt": {"knots": 25}}, "then": {"set": {"fast": True, "seal": ["sha256.hex()", "${vessel}", "${knots}"]}}, "else": {"set": {"fast": False}},
    })
    rows = ['{"vessel": "Terna", "knots": 31, "crew": ["o", "p"], "log": {"wind": 4}}', '{"knots": -1, "crew": ["o", 2, "q", "r"], "log": {"wind": 0.5}, "cargo": []}']
    out = crossing.apply(spark.createDataFrame([(r,) for r in rows], "d string").coalesce(1), "d")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = out.select(F.to_json("doc").alias("doc"), "errors").collect()
    for text, row in zip(rows, found, strict=True):
        doc, errors = crossing.check(text)
        assert sorted(map(tuple, row.errors)) == sorted(errors) and Validator({}).check(row.doc)[0] == doc
    assert [len(r.errors) for r in found] == [0, 6]
