import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import formats, templates
from docloom.functions.values import Flags
from docloom.operators.decode import DecodeError, decode, decode_column
from docloom.operators.validate import ValidationError, Validator, error_text, register_schema, registered
from docloom.plans.columns import Val
from docloom.plans.infer import schema_of, struct_of
from docloom.plans.schema import KEYWORDS, SchemaError, Step, add_comparator

# keyword under `properties.x`, then values of x that pass and that fail; null and another kind follow below
MATRIX = [
    ({"type": "string"}, ["a", ""], [1, True, [], {}]),
    ({"type": "integer"}, [1, 1.0, -3], [1.5, "1"]),
    ({"type": "number|boolean"}, [1.5, True], ["1", []]),
    ({"type": "object"}, [{"a": 1}], [[1], 1]),
    ({"maxLength": 3}, ["abc", [1, 2], "é"], ["abcd", "éé", [1, 2, 3, 4]]),
    ({"minLength": 2}, ["ab", "é", [1, 2]], ["a", [1]]),
    ({"maxB64DLen": 3}, ["abcd", "abcdefg"], ["abcdefgh"]),
    ({"minB64DLen": 3}, ["abcd"], ["abc"]),
    ({"maximum": 5}, [5, -1, "9"], [5.1, 6]),
    ({"minimum": 5, "exclusiveMinimum": True}, [5.1], [5, 4]),
    ({"exclusiveMaximum": 5}, [4.9], [5]),
    ({"exclusiveMinimum": 5}, [5.5], [5]),
    ({"enum": ["1", 2, True]}, ["1", 1, 2, "2", True, "true", 5], ["3", 0]),
    ({"const": "1"}, ["1", 1], ["2", True]),
    ({"multipleOf": 0.5}, [1, 1.5], [1.3]),
    ({"pattern": "^a+$"}, ["aaa", 5], ["b", "aab"]),
    ({"format": "date"}, ["2024-01-31", 3], ["2024-1-31"]),
    ({"uniqueItems": True}, [[1, "1", True], []], [[1, 1], [{}, 1], [None]]),
    ({"maxItems": 1}, [[], [1], "abc"], [[1, 2]]),
    ({"minItems": 1}, [[1]], [[]]),
    ({"items": {"minimum": 2}}, [[2, 3], 5], [[1, 2], [0, 1]]),
    ({"minProperties": 1}, [{"a": 1}], [{}]),
    ({"maxProperties": 1}, [{"a": 1}], [{"a": 1, "b": 2}]),
    ({"required": ["a"]}, [{"a": None}, 5], [{"b": 1}]),
    ({"properties": {"a": {"type": "integer"}}}, [{"a": 1}, {}], [{"a": "x"}, {"b": 1}, 5]),
    ({"properties": {"a": {}}, "additionalProperties": {"maximum": 2}}, [{"a": 9, "b": 1}], [{"b": 3, "c": 4}]),
    ({"children": {"a": {"maximum": 2}}}, [{"a": 1, "b": 9}, {}], [{"a": 3}]),
    ({"dependencies": {"a": ["b", "c"]}}, [{"a": 1, "b": 2, "c": 3}, {"b": 1}], [{"a": 1}, {"a": 1, "b": 1}]),
    ({"startWith": "a"}, ["ab", 1], ["b"]),
    ({"endWith": "a"}, ["ba"], ["b"]),
    ({"contains": "a"}, ["bab"], ["b"]),
    ({"startWiths": {"k": "a"}}, [{"k": "ab"}], [{"k": "b"}, {}]),
    ({"maxLengths": {"k": 2}}, [{"k": "ab"}, {}], [{"k": "abc"}]),
    ({"minLengths": {"k": 2}}, [{"k": "ab"}], [{"k": "a"}, {}]),
    ({"patterns": {"k": "^a"}}, [{"k": "ab"}], [{"k": "b"}]),
    ({"gt": {"k": 3}}, [{"k": 4}], [{"k": 3}, {"k": "9"}, {}]),
    ({"lte": {"k": "${m}"}}, [{"k": 1, "m": 2}, {}], [{"k": 3, "m": 2}]),
    ({"eq": {"k": "1"}}, [{"k": 1}, {"k": "1"}, 5], [{"k": 2}, {}]),
    ({"eq": {"k": 1}}, [{"k": 1}], [{"k": "1"}]),
    ({"neq": {"k": ""}}, [{"k": "a"}], [{"k": ""}, {}]),
    ({"in": {"k": ["a", 1]}}, [{"k": "a"}, {"k": "1"}, {"k": 1}], [{"k": "b"}]),
    ({"notin": {"k": ["a", 1]}}, [{"k": "b"}], [{"k": "a"}]),
    ({"ipIn": {"k": ["10.0.0.0/8", "1.2.3.4"]}}, [{"k": "10.9.9.9"}, {"k": "1.2.3.4"}], [{"k": "11.0.0.1"}, {"k": "x"}, {}]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 7, None], [1]),
    ({"oneOf": [{"type": "string"}, {"type": "number"}]}, ["a", 7], [True]),
    ({"allOf": [{"type": "number"}, {"minimum": 5}]}, [7], [1, "a"]),
    ({"not": {"type": "string"}}, [1], ["a"]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 5}}, ["ab", 7], ["a", 1]),
    ({"switch": "t", "case": {"a": {"gt": {"v": 1}}}, "defaults": {"lt": {"v": 1}}}, [{"t": "a", "v": 2}, {"v": 0}], [{"t": "a", "v": 0}, {"t": "b", "v": 2}]),
]


def both(spark, spec, documents, flags=Flags()):
    """Errors and documents by the interpreter and by Columns, which must agree."""
    validator = Validator(spec, flags)
    plain = [validator.check(json.dumps(d)) for d in documents]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents)], "k int, doc_in string").coalesce(1)
    frame, *_ = validator.lower(df, "doc_in")
    rows = validator.apply(df, "doc_in").orderBy("k").select(F.to_json("doc").alias("d"), "errors", "valid").collect()
    for (doc, errors), row in zip(plain, rows, strict=True):
        assert sorted(errors) == sorted((e["path"], e["info"]) for e in row["errors"])
        assert row["valid"] == (not errors)
        assert json.loads(row["d"], parse_int=float) == doc
    return plain


@pytest.mark.parametrize("case", range(len(MATRIX)))
def test_keyword(spark, case):
    keyword, good, bad = MATRIX[case]
    spec = {"properties": {"x": keyword, "y": {}}}
    documents = [{"x": v} for v in [*good, *bad, None]] + [{"y": 1}]
    found = both(spark, spec, documents)
    assert [bool(e) for _, e in found[: len(good) + len(bad)]] == [False] * len(good) + [True] * len(bad)


def test_texts_variants_and_structs_agree(spark):
    spec = {"properties": {"a": {"type": "integer", "maximum": 3}, "b": {"enum": ["x", "y"]}, "c": {"items": {"maxLength": 2}}}, "required": ["a"], "lt": {"a": 3}}
    df = spark.createDataFrame([(1, 2, "x", ["ab"]), (2, 9, "z", ["abc", "a"]), (3, None, None, None)], "k int, a int, b string, c array<string>")
    struct = df.select("k", F.struct("a", "b", "c").alias("doc_in"))
    text = struct.select("k", F.to_json("doc_in", {"ignoreNullFields": "false"}).alias("doc_in"))
    variant = text.select("k", F.parse_json("doc_in").alias("doc_in"))
    results = [[sorted(map(tuple, r["errors"])) for r in Validator(spec).apply(x, "doc_in").orderBy("k").collect()] for x in (struct, text, variant)]
    assert results[0] == results[1] == results[2]
    assert [len(x) for x in results[0]] == [0, 4, 0]


def test_writes(spark):
    spec = {
        "properties": {"name": {"replaceKey": "name2", "formatVal": "upper"}, "age": {"default": 3}, "kind": {"constVal": "k"}},
        "defaultVals": {"scope": "all"},
        "set": {"meta.tag": "${name}_${age}", "sum": ["add()", "${age}", 1]},
        "setNN": {"none": "${missing}"},
        "setExpr": {"dyn_${kind}": "${age}"},
        "del": {"gone": ""},
        "delete": ["kind"],
    }
    found = both(spark, spec, [{"name": "bob"}, {"name": "al", "age": None}, {"age": 9}])
    # set comes before properties here, as priorities say
    assert found[0][0]["scope"] == "all" and found[0][0]["name"] == "BOB" and found[0][0]["name2"] == "bob" and "none" not in found[0][0]


def test_conditional_writes(spark):
    spec = {"if": {"eq": {"t": "a"}}, "then": {"set": {"out": "A"}}, "else": {"set": {"out": "B"}, "error": "no ${t}"}}
    found = both(spark, spec, [{"t": "a"}, {"t": "b"}])
    assert found[0] == ({"t": "a", "out": "A"}, []) and found[1] == ({"t": "b", "out": "B"}, [("$", "no b")])


def test_foreach_runs_in_the_interpreter(spark):
    spec = {"foreach": {"ws": {"foreach": {"__val.w": {"set": {"line": "${line}${__val.c}"}}}}}}
    document = {"ws": [{"w": [{"c": "ni"}, {"c": "hao"}]}]}
    validator = Validator(spec)
    assert not validator.lowerable and validator.check(document)[0]["line"] == "nihao"
    df = spark.createDataFrame([(json.dumps(document),)], "d string")
    assert json.loads(validator.apply(df, "d").select(F.to_json("doc")).first()[0])["line"] == "nihao"


def test_scripts(spark):
    spec = {"script": [{"if": "$.age < 18", "then": ["return('young', $.age)"]}, {"if": "$.name == nil", "then": "return('nameless', nil)"}, "x = 1"]}
    found = both(spark, spec, [{"age": 5}, {"age": 20}, {"age": 20, "name": "a"}])
    assert [e for _, e in found] == [[("$", "err :[young 5]")], [("$", "err :[nameless <nil>]")], []]
    ragged = Validator({"script": ["x = 1", {"if": "$.a == 1", "then": ["return(1, 2)"], "else": "return(3)"}]})
    assert not ragged.lowerable and ragged.check({"a": 1})[1] == [("$", "err :[1 2]")]
    writing = Validator({"script": ["$.n = 1", "delete($, 'm')"]})
    assert not writing.lowerable and writing.check({"m": 2})[0] == {"n": 1.0}


ADDRESSES = ["1.2.3.4", "::1", "::", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "1::2::3", ":1", "1:", ":::", "12345::", "g::", "1:2:3:4:5:6:1.2.3.4", "1.2.3", "01.2.3.4", "::1.2.3.400", "", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1:", ":1::2"]


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").coalesce(1)
    for name in ("ipv4", "ipv6"):
        got = [r[0] for r in df.select(formats.column_of(name)(df.a)).collect()]
        assert dict(zip(ADDRESSES, got, strict=True)) == {a: formats.FORMATS[name][0](a) for a in ADDRESSES}


def test_references(spark):
    spec = {"$defs": {"n": {"maximum": 3}}, "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"items": {"$ref": "#/$defs/n"}}}}
    found = both(spark, spec, [{"a": 1}, {"a": 9, "b": [1, 9]}])
    assert [len(e) for _, e in found] == [0, 2] and found[1][1][0][0].startswith("$.a")
    recursive = Validator({"properties": {"v": {"maximum": 3}, "child": {"$ref": "#/"}}})
    deep = {"v": 1, "child": {"v": 2, "child": {"v": 3, "child": {"v": 4}}}}
    assert [i for _, i in recursive.check(deep)[1]] == ["value must be <= than 3"]
    df = spark.createDataFrame([(json.dumps(deep),)], "d string")
    assert len(recursive.apply(df, "d").first()["errors"]) == 1
    with pytest.raises(SchemaError):
        Validator({"$ref": "#/nowhere"})


def test_compile_errors():
    for spec in ({"nope": 1}, {"type": "lower"}, {"maximum": "x"}, {"required": "a"}, {"pattern": "(?=a)"}, {"format": "x"}, {"multipleOf": 0}, {"oneOf": []}, {"properties": {"a": {}}, "required": ["b"]}, {"set": {"a": "f()"}}):
        with pytest.raises((SchemaError, templates.TemplateError)):
            Validator(spec)
    Validator({"title": "t", "$comment": "c", "mine": 1}, ignored={"mine"})


def test_quirks_are_kept_behind_a_flag():
    assert Validator({"maxProperties": 1}).check({"a": 1, "b": 2})[1] and not Validator({"maxProperties": 1}, Flags(strict=True)).check({"a": 1, "b": 2})[1]
    assert Validator({"set": {"x": ["sub()", 5, 3]}}).check({})[0] == {"x": 2.0}
    assert Validator({"set": {"x": ["sub()", 5, 3]}}, Flags(strict=True)).check({})[0] == {"x": 0.0}


def test_bad_json_and_nulls(spark):
    df = spark.createDataFrame([("{bad",), (None,), ("null",)], "d string")
    rows = Validator({"type": "object"}).apply(df, "d").collect()
    assert [len(r["errors"]) for r in rows] == [1, 0, 0] and rows[0]["errors"][0]["info"] == "invalid JSON"


def test_api():
    v = register_schema("user", {"properties": {"name": {"maxLength": 3}}})
    assert registered("user") is v and v.validate('{"name": "bob"}') == {"name": "bob"}
    with pytest.raises(ValidationError) as e:
        v.validate({"name": "robert"})
    assert str(e.value) == "'$.name' length must be less or equal than 3; " == error_text(v.check({"name": "robert"})[1])
    assert json.loads(v.dump()) == v.spec


def test_user_extensions(spark):
    formats.add_format("even", lambda s: len(s) % 2 == 0)
    add_comparator("longer", "should be longer than ", lambda a, b: len(str(a)) > len(str(b)), lambda a, b: F.length(a.string_of()) > F.length(b.string_of()))
    templates.add_function("twice", lambda doc, flags, x: str(x) * 2, lambda flags, x: Val(F.concat(x.string_of(), x.string_of()), T.StringType(), True))
    both(spark, {"properties": {"a": {"format": "even"}, "b": {}}, "longer": {"a": "${b}"}, "set": {"c": ["twice()", "${a}"]}}, [{"a": "abcd", "b": "abc"}, {"a": "abc", "b": "abcd"}])
    del KEYWORDS["longer"], templates.FUNCTIONS["twice"], formats.FORMATS["even"]


def test_extensions_reach_the_interpreter_on_executors(spark):
    class Never(Step):
        def __init__(self, path):
            self.path = path

        def run(self, ctx, value):
            ctx.add(self.path, "never")

    templates.add_function("shout", lambda doc, flags, x: str(x).upper() + "!")
    KEYWORDS["never"] = lambda arg, place: Never(place.path)
    v = Validator({"never": 1, "set": {"c": ["shout()", "${a}"]}, "mine": 1}, ignored={"mine"})
    row = v.apply(spark.createDataFrame([('{"a": "x"}',)], "d string"), "d").select(F.to_json("doc").alias("d"), "errors").first()
    assert json.loads(row.d)["c"] == "X!" and [e["info"] for e in row.errors] == ["never"]
    del KEYWORDS["never"], templates.FUNCTIONS["shout"]


def test_templates():
    doc = {"line": "name", "__val.c": "age", "n": 5.0, "list": ["a", "b"]}
    t = lambda x: templates.parse(x).get(doc)
    assert t(r"aseln.${line}_${__val\.c}") == "aseln.name_age" and t("${n}") == 5.0 and t("n=${n}") == "n=5"
    assert t(["str.join()", "${list}", "-"]) == "a-b" and t(["or()", "${x}", "", "d"]) == "d" and t({"a": "${n}", "b": ["new()"]}) == {"a": 5.0, "b": {}}
    assert t(["sprintf()", "%s/%d/%.1f/%v", "x", 3, 2.25, True]) == "x/3/2.2/true" and t(["map.get()", {"k": 1}, "k"]) == 1


def test_decode(spark):
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("ok", T.BooleanType()), T.StructField("msg", T.BinaryType()), T.StructField("kids", T.ArrayType(T.StringType()))])
    good = {"name": "a", "age": 3.7, "ok": 1.0, "msg": "aGk=", "kids": ["x"], "more": 1.0}
    assert decode(good, kind) == {"name": "a", "age": 3, "ok": True, "msg": b"hi", "kids": ["x"]}
    with pytest.raises(DecodeError, match=r"\$\.kids\[0\]"):
        decode({"kids": [1.0]}, kind)
    df = spark.createDataFrame([(json.dumps(good),), ('{"age": "3"}',)], "d string").select(F.parse_json("d").alias("d"))
    rows = [r[0] for r in df.select(decode_column(Val(F.col("d"), T.VariantType()), kind)).collect()]
    assert rows[0]["age"] == 3 and bytes(rows[0]["msg"]) == b"hi" and rows[1] is None


def test_generated_schema():
    kind = T.StructType([
        T.StructField("base", T.StructType([T.StructField("es", T.StringType(), metadata={"required": True})]), metadata={"inline": True}),
        T.StructField("age", T.IntegerType(), metadata={"maximum": 100, "multipleOf": 2}),
        T.StructField("childs", T.ArrayType(T.StringType()), metadata={"maxItems": 2}),
        T.StructField("more", T.MapType(T.StringType(), T.DoubleType())),
    ])
    made = schema_of(kind)
    assert made["required"] == ["es"] and made["properties"]["age"] == {"type": "integer", "maximum": 100, "multipleOf": 2}
    assert made["properties"]["more"]["additionalProperties"] == {"type": "number"}
    assert Validator(made).check({"es": "a", "age": 3})[1] == [("$.age", "value must be multipleOf 2,but:3, divide:1.5")]
    assert struct_of({"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}}).simpleString() == "struct<a:bigint,b:array<string>>"
