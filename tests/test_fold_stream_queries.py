import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom import cli, queries
from docloom.operators.fold import associative, fold
from docloom.operators.validate import Validator
from docloom.plans.rules.parser import parse_text
from docloom.sources.json import count_lines, read_binary, read_documents, read_lines, read_value
from docloom.streaming.validate import error_counts, split, validate_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"k": "a", "v": 1}\n\n{"k": "b", "v": 2}\n{"k": "a", "v": 3.5}\n')
    return str(path)


def test_fold_by_aggregation(spark, lines):
    df = read_lines(spark, lines)
    assert associative(parse_text("n++; s = s + $.v; m[$.k] = (m[$.k] or 0) + $.v")) is not None
    assert associative(parse_text("s = s + n; n++")) is None
    assert fold(df, "text", "s = s + $.v", "s = 10") == 16.5
    assert fold(df, "text", "n++; m[$.k] += $.v", "n = 0; m = {}", "{n: n, a: m.a, b: m.b}") == {"n": 3.0, "a": 4.5, "b": 2.0}


def test_fold_in_order(spark, lines):
    df = read_lines(spark, lines)
    assert fold(df, "text", "t = (t or '') + $.k + $idx", final="t", order="line") == "a0b1a2"
    with pytest.raises(Exception, match="row 0"):
        fold(df, "text", "t = 1 % 0", order="line")


def test_sources(spark, lines, tmp_path):
    one = tmp_path / "one.json"
    one.write_text('{"a": [1, 2]}')
    assert read_value(spark, str(one)) == {"a": [1.0, 2.0]} and count_lines(spark, lines) == 4
    assert read_documents(spark, str(one)).count() == 1 and bytes(read_binary(spark, str(one)).first().content) == b'{"a": [1, 2]}'


def test_cli(spark, lines, tmp_path, capsys, monkeypatch):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "a.rule").write_text("base = 5")
    assert cli.main(["-s", "base + 1", "--lib", str(lib)]) == 0
    assert cli.main(["-f", lines, "-e", "s = s + $.v", "-st", "s = 0", "--lib", "/none"]) == 0
    monkeypatch.setattr("sys.stdin", open(os.devnull))
    assert cli.main(["-n", "{a: 1}", "--lib", "/none"]) == 0
    assert cli.main(["-n", "panic('no')", "--lib", "/none"]) == 1
    assert capsys.readouterr().out == '6\n6.5\n{\n  "a": 1\n}\n'


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, '{"v": 1}'), (2, '{"v": 9}'), (3, "{")], "id int, doc_in string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(source)
    stream = lambda: spark.readStream.schema("id int, doc_in string, ts timestamp").parquet(source)
    validator = Validator({"properties": {"v": {"maximum": 5}}})
    good, bad = [], []
    split(stream(), validator, "doc_in", lambda df, e: good.extend(r.id for r in df.collect()), lambda df, e: bad.extend(r.id for r in df.collect())).start().processAllAvailable()
    assert good == [1] and sorted(bad) == [2, 3]
    assert validate_stream(stream(), validator, "doc_in").isStreaming
    query = error_counts(stream(), validator, "doc_in", "ts").writeStream.format("memory").queryName("found").outputMode("update").start()
    query.processAllAvailable()
    assert {(r.path, r.n) for r in spark.table("found").collect()} == {("$.v", 1), ("$", 1)}
    query.stop()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(cell(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(cell(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_plans(spark):
    """Predicates prune columns, reach no Python and shuffle nothing."""
    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = Validator({"gt": {"o_totalprice": 5}}).valid(queries.doc_of(df, "o_orderkey", "o_totalprice", "o_orderstatus"), "doc").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "o_orderstatus" not in plan
    assert json.loads(Validator({"type": "object"}).dump()) == {"type": "object"}
