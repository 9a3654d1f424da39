"""Queries over the driver's tables, one or more for each family of operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.values import Flags
from docloom.operators.decode import decode_column
from docloom.operators.fold import Sum, totals
from docloom.operators.rules import RETURN, Rule
from docloom.operators.validate import Validator, error_text_column
from docloom.plans.columns import Val
from docloom.plans.infer import schema_of
from docloom.plans.rules.parser import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; one of fewer partitions than cores is dealt out, since what follows costs more than the rows."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df, cores = df.select(*columns) if columns else df, spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < cores and df.rdd.getNumPartitions() < cores else df


def doc_of(df: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """key and a struct of columns as the document."""
    return df.select(F.col(key).alias("id"), F.struct(*columns).alias("doc"))


def errors_of(df: DataFrame, spec: dict, flags: Flags = Flags(), key: str = "id") -> DataFrame:
    """One row for each error of each document."""
    done = Validator(spec, flags).apply(df, "doc")
    return done.select(key, F.explode_outer("errors").alias("e")).where("e IS NOT NULL").select(key, F.col("e.path").alias("path"), F.col("e.info").alias("info"))


def text_at(name: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("doc"), path, kind).alias(name)


def bad(source: str, key: str, *rules: tuple[str, str, str]) -> str:
    """The same as `errors_of` in SQL: (condition, path, SQL of the info)."""
    return "\nUNION ALL ".join(f"SELECT {key} AS id, '{path}' AS path, {info} AS info FROM {source} WHERE {test}" for test, path, info in rules)


# ---- predicates -------------------------------------------------------------------------

@query(bad("events", "event_id", ("value <> floor(value)", "$.value", "'type should be integer, but float:' || printf('%.2f', value).rtrim('0').rtrim('.')"), ("event_type IS NULL", "$.event_type", "'field is required'"), ("true", "$.nothing", "'field is required'")))
def v_type_required(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct("event_id", "event_type", "value")).alias("doc"))
    spec = {"type": "object", "properties": {"event_id": {"type": "integer"}, "event_type": {"type": "string"}, "value": {"type": "integer"}, "nothing": {}}, "required": ["event_type", "nothing"]}
    return errors_of(events, spec)


@query("SELECT event_id AS id, '$.k' AS path, 'type should be one of string|boolean' AS info FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def v_type_union(spark, sf):
    return errors_of(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc")), {"properties": {"k": {"type": "string|boolean"}}})


@query(bad("lineitem", "l_orderkey * 10 + l_linenumber", ("l_discount > 0.08", "$.l_discount", "'value must be <= than 0.08'"), ("l_quantity <= 3", "$.l_quantity", "'value must be larger than 3'"), ("l_tax >= 0.07", "$.l_tax", "'value should be < 0.07'"), ("l_extendedprice < 1000", "$.l_extendedprice", "'value must be larger or equal than 1000'")))
def v_range(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    spec = {"properties": {"l_discount": {"maximum": 0.08}, "l_quantity": {"minimum": 3, "exclusiveMinimum": True}, "l_tax": {"exclusiveMaximum": 0.07}, "l_extendedprice": {"minimum": 1000}}}
    return errors_of(doc_of(items, "k", "l_discount", "l_quantity", "l_tax", "l_extendedprice"), spec)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, '$.l_quantity' AS path, 'value must be multipleOf 4,but:' || l_quantity::BIGINT || ', divide:' || printf('%.2f', l_quantity / 4).rtrim('0').rtrim('.') AS info FROM lineitem WHERE l_quantity / 4 <> floor(l_quantity / 4)")
def v_multiple_of(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return errors_of(doc_of(items, "k", "l_quantity"), {"properties": {"l_quantity": {"multipleOf": 4}}})


@query(bad("documents", "doc_id", ("strlen(text) > 2000", "$.text", "'length must be less or equal than 2000'"), ("strlen(text) < 300", "$.text", "'length must be larger or equal than 300'")))
def v_length(spark, sf):
    return errors_of(doc_of(table(spark, sf, "documents"), "doc_id", "text"), {"properties": {"text": {"maxLength": 2000, "minLength": 300}}})


@query(bad("(SELECT *, base64(encode(c_mktsegment)) AS b FROM customer)", "c_custkey", ("strlen(b) // 4 * 3 > 10", "$.b", "'length is invalid, max length is  10'"), ("strlen(b) // 4 * 3 < 10", "$.b", "'length is invalid ,min length is  10'")))
def v_b64len(spark, sf):
    return errors_of(doc_of(table(spark, sf, "customer"), "c_custkey", F.base64(F.col("c_mktsegment").cast("binary")).alias("b")), {"properties": {"b": {"maxB64DLen": 10, "minB64DLen": 10}}})


@query(bad("orders", "o_orderkey", ("o_orderstatus NOT IN ('F', 'O')", "$.o_orderstatus", "'value is invalid , shoule be one of [F O]'"), ("(o_orderkey % 4)::VARCHAR NOT IN ('1', '2')", "$.m", "'value is invalid , shoule be one of [1 2]'"), ("o_orderkey % 4 <> 3", "$.c", "'value is invalid , expected: 3'")))
def v_enum_const(spark, sf):
    m = F.col("o_orderkey") % 4
    spec = {"properties": {"o_orderstatus": {"enum": ["F", "O"]}, "m": {"enums": ["1", 2]}, "c": {"const": "3"}}}
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", m.alias("m"), m.alias("c")), spec)


@query(bad("part", "p_partkey", ("NOT regexp_matches(p_brand, '#[1-3][1-3]$')", "$.p_brand", "p_brand || ' ,value does not match pattern: #[1-3][1-3]$'"), ("NOT regexp_matches(p_type, '^[A-Z]+ (PLATED|BRUSHED)')", "$.p_type", "'should match pattern ^[A-Z]+ (PLATED|BRUSHED)'")))
def v_pattern(spark, sf):
    spec = {"allOf": [{"properties": {"p_brand": {"pattern": "#[1-3][1-3]$"}, "p_type": {}}}, {"patterns": {"p_type": "^[A-Z]+ (PLATED|BRUSHED)"}}]}
    return errors_of(doc_of(table(spark, sf, "part"), "p_partkey", "p_brand", "p_type"), spec)


@query(r"SELECT page_id AS id, '$.url' AS path, 'invalid uri' AS info FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '//') ELSE url END AS url FROM pages) WHERE NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(url, '[\x00-\x1f\x7f]')")
def v_format_uri(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit("//"))).otherwise(F.col("url"))
    return errors_of(doc_of(table(spark, sf, "pages"), "page_id", url.alias("url")), {"properties": {"url": {"format": "uri"}}})


MISC = "(SELECT c_custkey, strftime(DATE '2024-01-28' + (c_custkey % 5)::INT, '%Y-%m-%d') || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS day, '10.0.' || (c_custkey % 300) || '.1' AS ip, c_phone, '/a/' || CASE WHEN c_custkey % 2 = 0 THEN '~0' ELSE '~' END AS ptr, 'h' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE '.com' END AS host FROM (SELECT *, '1' || lpad(c_custkey::VARCHAR, 9 + (c_custkey % 2)::INT, '0') AS c_phone FROM customer))"


@query(bad(MISC, "c_custkey", ("c_custkey % 3 = 0", "$.day", "'invalid date'"), ("c_custkey % 300 > 255", "$.ip", "'invalid ipv4'"), ("c_custkey % 2 = 0", "$.phone", "'invalid phone'"), ("c_custkey % 2 = 1", "$.ptr", "'invalid json-pointer'")))
def v_format_misc(spark, sf):
    k = F.col("c_custkey")
    day = F.concat(F.date_format(F.date_add(F.lit("2024-01-28").cast("date"), (k % 5).cast("int")), "yyyy-MM-dd"), F.when(k % 3 == 0, "x").otherwise(""))
    ip = F.concat(F.lit("10.0."), (k % 300).cast("string"), F.lit(".1"))
    phone = F.concat(F.lit("1"), F.lpad(k.cast("string"), (9 + k % 2).cast("int"), F.lit("0")))
    ptr = F.concat(F.lit("/a/"), F.when(k % 2 == 0, "~0").otherwise("~"))
    spec = {"properties": {"day": {"format": "date"}, "ip": {"format": "ipv4"}, "phone": {"format": "phone"}, "ptr": {"format": "json-pointer"}}}
    return errors_of(doc_of(table(spark, sf, "customer"), "c_custkey", day.alias("day"), ip.alias("ip"), phone.alias("phone"), ptr.alias("ptr")), spec)


@query("""
SELECT vec_id AS id, '$.embedding[*]' AS path, 'value must be <= than 0.2' AS info, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2::FLOAT GROUP BY vec_id
UNION ALL SELECT vec_id, '$.embedding', ' max length is 10', 1 FROM embeddings WHERE len(embedding) > 10
UNION ALL SELECT vec_id, '$.labels', ' items should be unique', 1 FROM embeddings WHERE label % 2 = 0
""")
def v_array_items(spark, sf):
    df = table(spark, sf, "embeddings")
    labels = F.array(F.col("label"), F.when(F.col("label") % 2 == 0, F.col("label")).otherwise(F.col("label") + 1))
    limit = float(spark.range(1).select(F.lit(0.2).cast("float").cast("double")).first()[0])
    spec = {"properties": {"embedding": {"items": {"maximum": limit}, "maxItems": 10}, "labels": {"uniqueItems": True}}}
    found = errors_of(doc_of(df, "vec_id", "embedding", labels.alias("labels")), spec)
    info = F.when(F.col("info").startswith("value must be"), "value must be <= than 0.2").otherwise(F.col("info"))
    return found.withColumn("info", info).groupBy("id", "path", "info").agg(F.count("*").alias("n"))


@query("""
SELECT event_id AS id, '$.' || key AS path, 'unknown field' AS info FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events WHERE event_id % 2 = 0) WHERE key <> 'k'
UNION ALL SELECT event_id, '$.extra', 'unknown field' FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, '$', 'max properties is :1' FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, '$', 'min properties is : 2' FROM events WHERE event_id % 2 = 1
""")
def v_closed_object(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ', "extra": 1}')).otherwise(F.col("props"))
    df = table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("doc"))
    return errors_of(df, {"properties": {"k": {}}, "maxProperties": 1, "minProperties": 2})


@query("SELECT event_id AS id, '${*}' AS path, 'value must be <= than 50' AS info FROM events WHERE (props->>'$.k')::DOUBLE > 50")
def v_additional(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc"))
    return errors_of(df, {"properties": {"other": {}}, "additionalProperties": {"maximum": 50}})


@query("SELECT o_orderkey AS id, '$.price' AS path, 'is required' AS info FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1")
def v_dependencies(spark, sf):
    sparse = F.map_filter(
        F.create_map(F.lit("final"), F.when(F.col("o_orderstatus") == "F", "yes"), F.lit("price"), F.when(F.col("o_orderkey") % 2 == 0, "1")), lambda k, v: v.isNotNull()
    )
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(sparse).alias("doc"))
    return errors_of(df, {"dependencies": {"final": ["price"]}})


@query(bad("orders", "o_orderkey", ("NOT o_totalprice > 50000", "$.o_totalprice", "'should greater than 50000'"), ("NOT o_custkey < o_orderkey", "$.o_custkey", "'should less than' || o_orderkey"), ("o_orderstatus <> 'O'", "$.o_orderstatus", "'value must be O'"), ("o_orderpriority = '5-LOW'", "$.o_orderpriority", "'should not equal with 5-LOW'"), ("o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "$.o_orderpriority", "'should be one of  [1-URGENT 2-HIGH]'"), ("o_orderstatus IN ('P')", "$", "'is not valid'")))
def v_compare(spark, sf):
    spec = {"gt": {"o_totalprice": 50000}, "lt": {"o_custkey": "${o_orderkey}"}, "eq": {"o_orderstatus": "O"}, "neq": {"o_orderpriority": "5-LOW"}, "in": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "notin": {"o_orderstatus": ["P"]}}
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), spec)


@query(bad("part", "p_partkey", ("NOT starts_with(p_type, 'ECONOMY')", "$.p_type", "'should start with ECONOMY'"), ("NOT suffix(p_type, 'STEEL')", "$.p_type", "'should end with STEEL'"), ("NOT contains(p_name, 'a')", "$.p_name", "'should contains a'"), ("NOT starts_with(p_brand, 'Brand#1')", "$.p_brand", "' should start with Brand#1'"), ("strlen(p_name) > 12", "$.p_name", "'max length is 12'")))
def v_prefixes(spark, sf):
    spec = {"startWiths": {"p_type": "ECONOMY"}, "endWiths": {"p_type": "STEEL"}, "containss": {"p_name": "a"}, "maxLengths": {"p_name": 12}, "children": {"p_brand": {"startWith": "Brand#1"}}}
    return errors_of(doc_of(table(spark, sf, "part"), "p_partkey", "p_type", "p_name", "p_brand"), spec)


@query("SELECT event_id AS id, '$.ip' AS path, ' ip should be within [10.0.0.0/25 10.0.1.7]' AS info FROM events WHERE NOT (user_id % 512 < 128 OR user_id % 512 = 263)")
def v_ip_in(spark, sf):
    n = F.col("user_id") % 512
    ip = F.concat(F.lit("10.0."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"))
    return errors_of(doc_of(table(spark, sf, "events"), "event_id", ip.alias("ip")), {"ipIn": {"ip": ["10.0.0.0/25", "10.0.1.7"]}})


# ---- logic ------------------------------------------------------------------------------

ORDER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey AS id, path, info FROM orders, (VALUES ('$.o_orderstatus', 'value must be F'), ('$.o_totalprice', 'should greater than 200000')) AS e(path, info) WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 200000)")
def v_anyof(spark, sf):
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), {"anyOf": [{"eq": {"o_orderstatus": "F"}}, {"gt": {"o_totalprice": 200000}}]})


@query("""
SELECT o_orderkey AS id, '$' AS path, 'more than one branch is valid' AS info FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
UNION ALL SELECT o_orderkey AS id, path, info FROM orders, (VALUES ('$.o_orderstatus', 'value must be F'), ('$.o_totalprice', 'should greater than 100000')) AS e(path, info) WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)
""")
def v_oneof(spark, sf):
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), {"exactlyOneOf": [{"eq": {"o_orderstatus": "F"}}, {"gt": {"o_totalprice": 100000}}]})


@query(bad("orders", "o_orderkey", ("o_orderstatus <> 'F'", "$.o_orderstatus", "'value must be F'"), ("o_totalprice <= 100000", "$.o_totalprice", "'should greater than 100000'")))
def v_allof(spark, sf):
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), {"allOf": [{"eq": {"o_orderstatus": "F"}}, {"and": [{"gt": {"o_totalprice": 100000}}]}]})


@query("SELECT o_orderkey AS id, '' AS path, 'is not valid' AS info FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def v_not(spark, sf):
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), {"not": {"eq": {"o_orderstatus": "F"}, "gt": {"o_totalprice": 100000}}})


@query("SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN '$.value' ELSE '$.user_id' END AS path, CASE WHEN event_type = 'purchase' THEN 'should greater than 50' ELSE 'should less than100' END AS info FROM events WHERE CASE WHEN event_type = 'purchase' THEN value <= 50 ELSE user_id >= 100 END")
def v_if_then_else(spark, sf):
    spec = {"if": {"eq": {"event_type": "purchase"}}, "then": {"gt": {"value": 50}}, "else": {"lt": {"user_id": 100}}}
    return errors_of(doc_of(table(spark, sf, "events"), "event_id", "event_type", "value", "user_id"), spec)


@query("SELECT event_id AS id, '$.value' AS path, CASE event_type WHEN 'click' THEN 'should greater than 10' WHEN 'view' THEN 'should greater than 20' ELSE 'should greater than 30' END AS info FROM events WHERE value <= CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 ELSE 30 END")
def v_switch(spark, sf):
    spec = {"switch": "event_type", "case": {"click": {"gt": {"value": 10}}, "view": {"gt": {"value": 20}}}, "defaults": {"gt": {"value": 30}}}
    return errors_of(doc_of(table(spark, sf, "events"), "event_id", "event_type", "value"), spec)


@query(bad("customer JOIN nation ON c_nationkey = n_nationkey", "c_custkey", ("n_nationkey > 10", "$.nation.key", "'value must be <= than 10'"), ("c_custkey > 10", "$.key", "'value must be <= than 10'")))
def v_ref(spark, sf):
    nation = table(spark, sf, "nation", "n_nationkey", "n_name")
    df = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    doc = doc_of(df, "c_custkey", F.col("c_custkey").alias("key"), F.struct(F.col("n_nationkey").alias("key")).alias("nation"))
    spec = {"$defs": {"keyed": {"properties": {"key": {"maximum": 10}, "nation": {}}}}, "allOf": [{"$ref": "#/$defs/keyed"}, {"children": {"nation": {"$ref": "#/$defs/keyed"}}}]}
    return errors_of(doc, spec)


@query("SELECT c_custkey AS id, '''$'' ' || c_name || ' of ' || c_mktsegment || '; ' AS text FROM customer WHERE c_acctbal < 0")
def v_error_template(spark, sf):
    spec = {"if": {"lt": {"c_acctbal": 0}}, "then": {"error": "${c_name} of ${c_mktsegment}"}}
    done = Validator(spec).apply(doc_of(table(spark, sf, "customer"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "doc")
    return done.where(~F.col("valid")).select("id", error_text_column(F.col("errors")).alias("text"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus IN ('F', 'O', 'P') AND NOT o_orderpriority = '5-LOW' GROUP BY 1")
def v_valid_rows(spark, sf):
    spec = {"properties": {"o_totalprice": {"minimum": 1000, "maximum": 300000}, "o_orderstatus": {"enum": ["F", "O", "P"]}, "o_orderpriority": {"not": {"const": "5-LOW"}}}}
    df = doc_of(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return Validator(spec).valid(df, "doc").groupBy(F.col("doc.o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, '$' AS path, 'err :[poor ' || c_name || ']' AS info FROM customer WHERE c_acctbal < 0")
def v_script(spark, sf):
    spec = {"script": [{"if": "$.c_acctbal < 0", "then": ["return('poor ' + $.c_name)"]}]}
    df = doc_of(table(spark, sf, "customer"), "c_custkey", "c_name", "c_acctbal")
    return errors_of(df, spec)


# ---- writes -----------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'none' END AS name, 7 AS level, 'all' AS scope FROM nation")
def t_defaults(spark, sf):
    sparse = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))), lambda k, v: v.isNotNull())
    df = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(sparse).alias("doc"))
    spec = {"properties": {"name": {"default": "none"}, "level": {"defaultVal": 7}}, "defaultVals": {"scope": "all"}}
    return Validator(spec).apply(df, "doc").select("id", text_at("name", "$.name"), text_at("level", "$.level", "int"), text_at("scope", "$.scope"))


@query("SELECT r_regionkey AS id, r_name AS name, r_name AS label, 'region' AS kind FROM region")
def t_const_replace(spark, sf):
    spec = {"properties": {"r_name": {"replaceKey": "label"}, "kind": {"constVal": "region"}}}
    done = Validator(spec).apply(doc_of(table(spark, sf, "region"), "r_regionkey", "r_name"), "doc")
    return done.select("id", text_at("name", "$.r_name"), text_at("label", "$.label"), text_at("kind", "$.kind"))


@query("SELECT n_nationkey AS id, lower(n_name) AS low, n_nationkey::VARCHAR AS key, n_nationkey > 0 AS flag FROM nation")
def t_format_val(spark, sf):
    spec = {"properties": {"low": {"formatVal": "lower"}, "key": {"formatVal": "string"}, "flag": {"formatVal": "bool"}}}
    n = F.col("n_nationkey")
    done = Validator(spec).apply(doc_of(table(spark, sf, "nation"), "n_nationkey", F.col("n_name").alias("low"), n.alias("key"), n.alias("flag")), "doc")
    return done.select("id", text_at("low", "$.low"), text_at("key", "$.key"), text_at("flag", "$.flag", "boolean"))


@query("SELECT event_id AS id, event_type || '_' || user_id AS tag, event_type AS kind, value * 2 AS double FROM events")
def t_set_paths(spark, sf):
    spec = {"set": {"meta.tag": "${event_type}_${user_id}", "meta.kind": "${event_type}"}, "setVal": {"double": ["mul()", "${value}", 2]}}
    done = Validator(spec).apply(doc_of(table(spark, sf, "events"), "event_id", "event_type", "user_id", "value"), "doc")
    return done.select("id", text_at("tag", "$.meta.tag"), text_at("kind", "$.meta.kind"), text_at("double", "$.double", "double"))


@query("SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'old' ELSE event_type END AS kind FROM events")
def t_set_nn(spark, sf):
    found = F.when(F.col("user_id") % 3 != 0, F.col("event_type"))
    done = Validator({"setNN": {"kind": "${found}"}}).apply(doc_of(table(spark, sf, "events"), "event_id", F.lit("old").alias("kind"), found.alias("found")), "doc")
    return done.select("id", text_at("kind", "$.kind"))


@query("SELECT event_id AS id, list_sort([event_type, 'n_' || (user_id % 3), 'value']) AS keys FROM events")
def t_set_expr(spark, sf):
    spec = {"setExpr": {"${event_type}": "${value}", "n_${m}": "${m}"}, "setMap": {"gone": 1}, "del": {"gone": ""}, "delete": ["event_type", "m"]}
    done = Validator(spec).apply(doc_of(table(spark, sf, "events"), "event_id", "event_type", "value", (F.col("user_id") % 3).alias("m")), "doc")
    return done.select("id", F.array_sort(F.map_keys(F.col("doc").try_cast("map<string,variant>"))).alias("keys"))


@query("SELECT conv_id AS id, string_agg(role, '' ORDER BY turn, role) AS line FROM conversations GROUP BY conv_id")
def t_foreach(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    spec = {"foreach": {"turns": {"set": {"line": "${line}${__val.role}"}}}}
    return Validator(spec).apply(doc_of(turns, "conv_id", "turns"), "doc").select("id", text_at("line", "$.line"))


@query("SELECT c_custkey AS id, md5(c_name || c_mktsegment) AS a, sha256(c_name) AS b, replace(upper(c_mktsegment), 'I', '-') AS c, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), 'none') AS d, regexp_replace(c_name, '^Customer#', '') AS e, c_custkey * 2 + 1 AS f FROM customer")
def t_templates(spark, sf):
    half = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    spec = {"set": {
        "a": ["md5.hex()", "${c_name}", "${c_mktsegment}"], "b": ["sha256.hex()", "${c_name}"], "c": ["str.replace()", ["str.toUpper()", "${c_mktsegment}"], "I", "-"],
        "d": ["or()", "${half}", "none"], "e": ["str.trimPrefix()", "${c_name}", "Customer#"], "f": ["add()", ["mul()", "${c_custkey}", 2], 1],
    }}
    done = Validator(spec).apply(doc_of(table(spark, sf, "customer"), "c_custkey", "c_custkey", "c_name", "c_mktsegment", half.alias("half")), "doc")
    return done.select("id", *(text_at(x, f"$.{x}") for x in "abcde"), text_at("f", "$.f", "bigint"))


# ---- rules ------------------------------------------------------------------------------


def rules(df: DataFrame, keys: list[str], /, **programs: str) -> DataFrame:
    """Keys and the value of each program, as Columns."""
    return df.select(*keys, *(Rule(text).column(df).alias(name) for name, text in programs.items()))


ITEM = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / l_quantity AS unit, -l_quantity + 1.5 AS neg, CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN 'nan' ELSE 'inf' END ELSE 'ok' END AS kind FROM lineitem")
def r_arith(spark, sf):
    df = table(spark, sf, "lineitem")
    out = rules(df, ITEM, charge="l_extendedprice * (1 - l_discount) * (1 + l_tax)", unit="l_extendedprice / l_quantity", neg="-l_quantity + 1.5", ratio="l_tax / l_discount")
    kind = F.when(F.isnan("ratio"), "nan").when(F.col("ratio") == float("inf"), "inf").otherwise("ok")
    return out.withColumn("kind", kind).drop("ratio")


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 7)::DOUBLE AS a, (l_partkey | 8)::DOUBLE AS o FROM lineitem")
def r_bitwise(spark, sf):
    return rules(table(spark, sf, "lineitem"), ITEM, a="l_partkey & 7", o="l_partkey | 8")


@query("SELECT l_orderkey, l_linenumber, power(l_quantity, 2) AS p, (l_partkey % 7)::DOUBLE AS m, sqrt(l_quantity) AS s FROM lineitem")
def r_pow_mod(spark, sf):
    return rules(table(spark, sf, "lineitem"), ITEM, p="l_quantity ^ 2", m="l_partkey % 7", s="sqrt(l_quantity)")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN 'big' WHEN o_totalprice > 50000 OR o_orderpriority = '1-URGENT' THEN 'mid' ELSE 'low' END AS size, NOT o_orderstatus = 'O' AS done, o_orderpriority < '3' AS early FROM orders")
def r_logic_ternary(spark, sf):
    return rules(table(spark, sf, "orders"), ["o_orderkey"], size="o_totalprice > 100000 && o_orderstatus == 'F' ? 'big' : o_totalprice > 50000 || o_orderpriority == '1-URGENT' ? 'mid' : 'low'", done="!(o_orderstatus == 'O')", early="o_orderpriority < '3'")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS a, o_orderkey % 5 IN (1, 3) AS b, o_orderpriority IN ('1-URGENT') AS c FROM orders")
def r_in(spark, sf):
    return rules(table(spark, sf, "orders"), ["o_orderkey"], a="o_orderstatus in ['F', 'P']", b="(o_orderkey % 5) in [1, 3]", c="inn(o_orderpriority, ['1-URGENT'])")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'none') AS a, o_orderkey % 2 = 1 AS b FROM orders")
def r_nil_coalesce(spark, sf):
    df = table(spark, sf, "orders").withColumn("maybe", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return rules(df, ["o_orderkey"], a="maybe or 'none'", b="maybe == nil")


@query("SELECT p_partkey, upper(p_name) AS up, starts_with(p_type, 'PROMO') AS promo, replace(p_name, 'a', '*') AS stars, trim(p_brand, 'B1') AS cut, strlen(p_name)::DOUBLE AS n, (instr(p_name, 'e') - 1)::DOUBLE AS e, contains(p_type, 'TIN') AS tin FROM part")
def r_string_methods(spark, sf):
    return rules(table(spark, sf, "part"), ["p_partkey"], up="p_name.to_upper()", promo="p_type.has_prefix('PROMO')", stars="p_name.replace('a', '*')", cut="p_brand.trim('B1')", n="p_name.len()", e="p_name.index('e')", tin="p_type.contains('TIN')")


@query("SELECT p_partkey, array_to_string(string_split(p_type, ' '), '-') AS a, string_split(p_type, ' ')[2] AS b, len(regexp_split_to_array(p_type, ' +'))::DOUBLE AS c FROM part")
def r_split_join(spark, sf):
    return rules(table(spark, sf, "part"), ["p_partkey"], a="p_type.split(' ').join('-')", b="p_type.split(' ')[1]", c="str_fields(p_type).len()")


@query("SELECT p_partkey, substring(p_type, 2, 4) AS a, substring(p_type, 3) AS b, CASE WHEN strlen(p_name) >= 12 THEN substring(p_name, 1, 12) ELSE '' END AS c, CASE WHEN len(string_split(p_type, ' ')) >= 3 THEN string_split(p_type, ' ')[2:3] END AS d FROM part")
def r_slice(spark, sf):
    return rules(table(spark, sf, "part"), ["p_partkey"], a="p_type[1:5]", b="p_type[2:]", c="p_name.slice(0, 12)", d="p_type.split(' ')[1:3]")


@query("SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b, base64(encode(c_name)) AS c, lower(hex(encode(c_name))) AS d, c_name AS e FROM customer")
def r_hash_encode(spark, sf):
    return rules(table(spark, sf, "customer"), ["c_custkey"], a="c_name.md5().hex()", b="hex_encode(sha256_sum(c_name))", c="base64_encode(c_name)", d="c_name::hex()", e="c_name::base64()::base64d()::string()")


@query("SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d, epoch(o_orderdate) AS u, epoch(o_orderdate + INTERVAL 1500 MILLISECOND) * 1000 AS later, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f FROM orders")
def r_time(spark, sf):
    return rules(table(spark, sf, "orders"), ["o_orderkey"], y="o_orderdate.year()", m="o_orderdate.month()", d="o_orderdate.day()", u="o_orderdate.unix()", later="o_orderdate.add_mill(1500).unix_mill()", f="o_orderdate.format('2006/01/02 15:04')")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::DOUBLE AS pos, list_transform(embedding[1:3], lambda x: x::DOUBLE * 2) AS twice, list_reverse_sort(embedding)[1]::DOUBLE AS top FROM embeddings")
def r_array_hof(spark, sf):
    out = rules(table(spark, sf, "embeddings"), ["vec_id"], pos="embedding.all(x => x > 0).len()", twice="embedding[0:3].filter(x => x * 2)", top="embedding.sort({a, b} => a > b)[0]")
    return out.withColumn("top", F.col("top").cast("double"))


@query("SELECT event_id, ['k', 't'] AS keys, 'k=' || (props->>'$.k') || '&t=' || event_type AS text, 1.0::DOUBLE AS n, true AS same FROM events")
def r_map_ops(spark, sf):
    df = table(spark, sf, "events")
    return rules(df, ["event_id"], keys="to_json_obj(props).merge({t: event_type}).keys()", text="to_json_obj(props).merge({t: event_type}).to_string('=', '&')", n="to_json_obj(props).some('k').len()", same="to_json_obj(props).exclude('k').merge(to_json_obj(props)).equals(to_json_obj(props))")


@query(r"SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has, len(regexp_extract_all(text, '[a-z]+ing\b'))::DOUBLE AS n, coalesce(list_extract(regexp_extract_all(text, '([a-z]+)ing\b', 1), 1), 'none') AS first FROM documents")
def r_regex(spark, sf):
    return rules(table(spark, sf, "documents"), ["doc_id"], has="regmatch('[0-9]{3}', text)", n=r"regfind('[a-z]+ing\\b', text).len()", first=r"regfind('([a-z]+)ing\\b', text)[0][1] or 'none'")


@query("SELECT event_id, (props->>'$.k')::DOUBLE + 1 AS k, '{\"k\":' || (props->>'$.k') || '}' AS text FROM events")
def r_json(spark, sf):
    return rules(table(spark, sf, "events"), ["event_id"], k="number(to_json_obj(props).k) + 1", text="to_json_str(to_json_obj(props))")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size FROM lineitem")
def r_if_chain(spark, sf):
    return rules(table(spark, sf, "lineitem"), ITEM, size="if(l_quantity < 10).then('few').elseif(l_quantity < 30, 'some').else('many').end()")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END::DOUBLE AS code FROM lineitem")
def r_switch_chain(spark, sf):
    return rules(table(spark, sf, "lineitem"), ITEM, code="switch(l_returnflag).case('R', 1).case('A', 2).default(9).end()")


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN x::DOUBLE ELSE 0 END)) AS total, len(list_filter(embedding, lambda x: x > 0))::DOUBLE AS n FROM embeddings")
def r_for_loop(spark, sf):
    program = ["total = 0", "n = 0", {"for": "x in embedding", "do": [{"if": "x > 0", "then": ["total = total + x", "n++"]}]}]
    return Rule(program).apply(table(spark, sf, "embeddings"), "v", {"total": "total", "n": "n"}).select("vec_id", "total", "n")


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total FROM embeddings")
def r_lambda(spark, sf):
    return rules(table(spark, sf, "embeddings"), ["vec_id"], total="sum = 0; for(embedding, x => sum = sum + x); sum")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'final' END AS verdict, CASE WHEN o_totalprice > 200000 OR o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END::DOUBLE AS seen FROM orders")
def r_script_return(spark, sf):
    program = ["seen = 0", {"if": "o_totalprice > 200000", "then": ["return('big')"]}, {"if": "o_orderstatus == 'F'", "then": "return('final')"}, "seen = 1"]
    return Rule(program).apply(table(spark, sf, "orders"), "v", {RETURN: "verdict", "seen": "seen"}).select("o_orderkey", "verdict", "seen")


@query("SELECT n_nationkey, (n_nationkey * (n_nationkey - 1) / 2)::DOUBLE AS total FROM nation")
def r_interpreted(spark, sf):
    """A while loop has no Column form: the interpreter runs it in Arrow batches."""
    out = Rule("i = 0; t = 0; loop(i < n_nationkey, t = t + i; i++); t").apply(table(spark, sf, "nation"))
    return out.select("n_nationkey", F.try_variant_get("value", "$", "double").alias("total"))


# ---- fold, decode, inference ------------------------------------------------------------


@query("SELECT 'total' AS name, NULL::VARCHAR AS key, sum((props->>'$.k')::DOUBLE) AS total FROM events UNION ALL SELECT 'n', NULL, count(*)::DOUBLE FROM events")
def f_fold_sum(spark, sf):
    df = table(spark, sf, "events").select(F.col("props").alias("doc"))
    return totals(df, "doc", [Sum("total", parse("$.k")), Sum("n", parse("1"))])


@query("SELECT 'by' AS name, event_type AS key, sum(value) AS total FROM events GROUP BY event_type")
def f_fold_group(spark, sf):
    df = table(spark, sf, "events").select(F.to_json(F.struct("event_type", "value")).alias("doc"))
    return totals(df, "doc", [Sum("by", parse("$.value"), parse("$.event_type"))])


@query("SELECT event_id AS id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::DOUBLE > 0 AS flag FROM events")
def d_decode(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.parse_json(F.regexp_replace("props", r'"k": ([\d.]+)', r'"k": $1, "flag": $1')).alias("doc"))
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("flag", T.BooleanType())])
    return df.select("id", decode_column(Val(F.col("doc"), T.VariantType()), kind).alias("d")).select("id", "d.k", "d.flag")


@query("SELECT o_orderkey AS id, '$.o_orderstatus' AS path, 'value is invalid , shoule be one of [F O]' AS info FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, '$.o_totalprice', 'value must be <= than 250000' FROM orders WHERE o_totalprice > 250000")
def s_schema_infer(spark, sf):
    kind = T.StructType([
        T.StructField("o_orderstatus", T.StringType(), metadata={"enum": ["F", "O"], "required": True}),
        T.StructField("o_totalprice", T.DoubleType(), metadata={"maximum": 250000}),
    ])
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", "o_totalprice"), schema_of(kind))


FLAGSHIP = {
    "type": "object",
    "properties": {
        "event_type": {"type": "string", "enum": ["click", "view", "purchase", "signup"], "formatVal": "upper"},
        "value": {"type": "number", "minimum": 1, "maximum": 90},
        "user_id": {"type": "integer", "minimum": 0},
        "source": {"default": "web"},
    },
    "required": ["event_type", "value"],
    "if": {"eq": {"event_type": "PURCHASE"}},
    "then": {"gt": {"value": 5}},
}


@query("""
SELECT upper(event_type) AS event_type, valid, count(*) AS n FROM (
  SELECT event_type, event_type IN ('click', 'view', 'purchase', 'signup') AND value BETWEEN 1 AND 90 AND user_id >= 0 AND NOT (event_type = 'purchase' AND value <= 5) AS valid FROM events) GROUP BY 1, 2
""")
def flagship(spark, sf):
    events = table(spark, sf, "events").select(F.to_json(F.struct("event_type", "value", "user_id")).alias("doc"))
    done = Validator(FLAGSHIP).apply(events, "doc")
    return done.groupBy(F.try_variant_get("doc", "$.event_type", "string").alias("event_type"), "valid").agg(F.count("*").alias("n"))


from docloom import queries_names as _names  # noqa: E402, F401  registers its queries here
