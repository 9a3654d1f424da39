"""Queries that go through the keywords, formats, template functions, rule functions and methods by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.fold import fold
from docloom.operators.rules import Rule
from docloom.operators.validate import Validator
from docloom.queries import ORDER, QUERIES, ORACLES, bad, doc_of, errors_of, query, table, text_at

# ---- keywords ---------------------------------------------------------------------------


@query(bad("orders", "o_orderkey", ("NOT o_totalprice >= 50000", "$.o_totalprice", "'should greater or equal than 50000'"), ("NOT o_custkey <= 100", "$.o_custkey", "'should less or equal  than 100'"), ("o_orderstatus <> 'O'", "$.o_orderstatus", "'value must be O'"), ("o_orderpriority <> '5-LOW'", "$.o_orderpriority", "'value must be 5-LOW'"), ("strlen(o_orderpriority) < 6", "$.o_orderpriority", "'min length is 6'")))
def v_compare_more(spark, sf):
    spec = {"gte": {"o_totalprice": 50000}, "lte": {"o_custkey": 100}, "equals": {"o_orderstatus": "O"}, "keyMatch": {"o_orderpriority": "5-LOW"}, "minLengths": {"o_orderpriority": 6}}
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), spec)


@query(bad("part", "p_partkey", ("NOT suffix(p_type, 'STEEL')", "$.p_type", "' should end with STEEL'"), ("NOT contains(p_type, 'PLATED')", "$.p_type", "' should contains PLATED'")))
def v_single_texts(spark, sf):
    return errors_of(doc_of(table(spark, sf, "part"), "p_partkey", "p_type"), {"children": {"p_type": {"endWith": "STEEL", "contains": "PLATED"}}})


@query("SELECT vec_id AS id, '$.labels' AS path, ' min length is 3' AS info FROM embeddings WHERE vec_id % 4 + 1 < 3")
def v_min_items(spark, sf):
    labels = F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))
    return errors_of(doc_of(table(spark, sf, "embeddings"), "vec_id", labels.alias("labels")), {"properties": {"labels": {"minItems": 3}}})


EITHER = "SELECT o_orderkey AS id, path, info FROM orders, (VALUES ('$.o_orderstatus', 'value must be F'), ('$.o_totalprice', 'should less than100000')) AS e(path, info) WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000)"


@query(EITHER)
def v_one_of(spark, sf):
    """`oneOf` is not exclusive."""
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), {"oneOf": [{"eq": {"o_orderstatus": "F"}}, {"lt": {"o_totalprice": 100000}}]})


@query(EITHER)
def v_or_definitions(spark, sf):
    spec = {"definitions": {"cheap": {"lt": {"o_totalprice": 100000}}}, "or": [{"eq": {"o_orderstatus": "F"}}, {"$ref": "#/definitions/cheap"}]}
    return errors_of(doc_of(table(spark, sf, "orders"), "o_orderkey", *ORDER), spec)


#: Format, a text that has it, one that has not.
SAMPLES = (
    ("date-time", "2024-01-28T10:11:12Z", "2024-01-28 10:11"), ("time", "10:11:12Z", "10-11"), ("email", "ann@docs.example", "docs.example"), ("idn-email", "bob@docs.example", "bob@"),
    ("hostname", "a.b-c.example", "-a.example"), ("idn-hostname", "bücher", "bü cher"), ("ipv6", "2001:db8::1", "2001:db8"), ("uri-reference", "/a/b?c=d#e", "a\\b"), ("iri", "http://bücher.example/é", "no scheme"),
    ("iri-reference", "é/x", ":x"), ("uri-template", "/docs/{id}/x", "/docs/{id"), ("relative-json-pointer", "1/a", "-1"), ("regex", "^a+[b-d]$", "(a"),
)


@query(f"SELECT c_custkey AS id, '$.f' || k AS path, 'invalid ' || name AS info FROM customer, (VALUES {', '.join(f"({k}, '{name}')" for k, (name, _, _) in enumerate(SAMPLES))}) AS f(k, name) WHERE (c_custkey + k) % 3 = 0")
def v_formats(spark, sf):
    fields = [F.when((F.col("c_custkey") + k) % 3 == 0, wrong).otherwise(right).alias(f"f{k}") for k, (_, right, wrong) in enumerate(SAMPLES)]
    return errors_of(doc_of(table(spark, sf, "customer"), "c_custkey", *fields), {"properties": {f"f{k}": {"format": name} for k, (name, _, _) in enumerate(SAMPLES)}})


# ---- templates --------------------------------------------------------------------------


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN ['b', 'kind'] ELSE ['a', 'kind'] END AS keys FROM customer")
def t_delete_by_key(spark, sf):
    doc = doc_of(table(spark, sf, "customer"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("kind"), F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("x"))
    done = Validator({"allOf": [{"delMap": {"${kind}": ""}}, {"call": ["delete()", "x"]}]}).apply(doc, "doc")
    return done.select("id", F.array_sort(F.map_keys(F.col("doc").try_cast("map<string,variant>"))).alias("keys"))


#: Name, template, kind of the result, SQL.
COLUMNS = (
    ("a", ["append()", "${c_name}", "-", "${c_custkey}"], "string", "c_name || '-' || c_custkey"), ("b", ["sub()", "${c_custkey}", 1, 2], "double", "(c_custkey - 3)::DOUBLE"), ("c", ["div()", "${c_custkey}", 4], "double", "c_custkey / 4"),
    ("d", ["mod()", "${c_custkey}", 7], "double", "(c_custkey % 7)::DOUBLE"), ("e", ["str.join()", ["str.split()", "${c_name}", "#"], "+"], "string", "replace(c_name, '#', '+')"), ("f", ["str.trimSuffix()", "${c_mktsegment}", "ING"], "string", "regexp_replace(c_mktsegment, 'ING$', '')"),
    ("g", ["str.trim()", "${c_mktsegment}", "AEG"], "string", "trim(c_mktsegment, 'AEG')"), ("h", ["str.toLower()", "${c_mktsegment}"], "string", "lower(c_mktsegment)"), ("i", ["tostring()", "${c_custkey}"], "string", "c_custkey::VARCHAR"),
    ("j", ["tonumber()", ["str.trimPrefix()", "${c_name}", "Customer#"]], "double", "replace(c_name, 'Customer#', '')::DOUBLE"), ("k", ["toint()", "${c_acctbal}"], "double", "trunc(c_acctbal) + 0"), ("l", ["tobool()", "${even}"], "boolean", "c_custkey % 2 = 0"),
    ("m", ["json.to()", {"k": "${c_custkey}"}], "string", "'{\"k\":' || c_custkey || '}'"), ("n", ["map.get()", ["json.from()", "${js}"], "k"], "double", "c_custkey::DOUBLE"),
)


def customers(spark, sf) -> DataFrame:
    even, js = (F.col("c_custkey") % 2 == 0).alias("even"), F.concat(F.lit('{"k": '), F.col("c_custkey").cast("string"), F.lit("}")).alias("js")
    obj = F.struct(F.lit(1).alias("z")).alias("obj")
    return doc_of(table(spark, sf, "customer"), "c_custkey", "c_custkey", "c_name", "c_mktsegment", "c_acctbal", even, js, obj)


@query(f"SELECT c_custkey AS id, {', '.join(f'{sql} AS {name}' for name, _, _, sql in COLUMNS)} FROM customer")
def t_template_functions(spark, sf):
    done = Validator({"set": {name: t for name, t, _, _ in COLUMNS}}).apply(customers(spark, sf), "doc")
    return done.select("id", *(text_at(name, f"$.{name}", kind) for name, _, kind, _ in COLUMNS))


@query("SELECT c_custkey AS id, '\"' || c_name || '\"' AS q, printf('%s has %d', c_name, c_custkey) AS s, c_custkey::DOUBLE AS k, 32 AS n16, 64 AS n32, true AS later, ['c_custkey', 'c_name', 'empty', 'even', 'js', 'later', 'n16', 'n32', 'obj', 'q', 's'] AS keys FROM customer")
def t_template_effects(spark, sf):
    """What only the interpreter has: quoting, verbs, writes into objects, time and random texts."""
    spec = {"allOf": [
        {"call": ["map.set()", "${obj}", "k", "${c_custkey}"]}, {"call": ["map.del()", "c_acctbal"]}, {"call": ["delete()", "c_mktsegment"]},
        {"set": {"q": ["str.quote()", "${c_name}"], "s": ["sprintf()", "%s has %d", "${c_name}", "${c_custkey}"], "n16": ["rand.new16()"], "n32": ["rand.new32()"], "later": ["time.now()"], "empty": ["new()"]}},
    ]}
    done = Validator(spec).apply(customers(spark, sf), "doc")
    return done.select(
        "id", text_at("q", "$.q"), text_at("s", "$.s"), text_at("k", "$.obj.k", "double"), F.length(text_at("x", "$.n16")).alias("n16"), F.length(text_at("x", "$.n32")).alias("n32"),
        (text_at("x", "$.later", "double") > 1.6e9).alias("later"), F.array_sort(F.map_keys(F.col("doc").try_cast("map<string,variant>"))).alias("keys"),
    )


# ---- rules ------------------------------------------------------------------------------


def program_query(name: str, kinds: dict[str, tuple[tuple[str, str], ...]], before: tuple = ()) -> None:
    """A query over nation whose columns are the values of expressions: kind -> (expression, SQL with k the key as DOUBLE and s the name)."""
    items = [(f"{kind[0]}{n}", kind, text, sql) for kind, pairs in kinds.items() for n, (text, sql) in enumerate(pairs)]
    program = [*before, *(f"{column} = {text}" for column, _, text, _ in items)]

    def run(spark, sf):
        out = Rule(program).apply(table(spark, sf, "nation", "n_nationkey", "n_name"), "value", {c: c for c, _, _, _ in items}, interpret=True)
        return out.select("n_nationkey", *(F.try_variant_get(c, "$", kind).alias(c) for c, kind, _, _ in items))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT n_nationkey, {', '.join(f'{sql} AS {c}' for c, _, _, sql in items)} FROM (SELECT *, n_nationkey::DOUBLE AS k, n_name AS s FROM nation)"


program_query("r_functions", {
    "double": (
        ("sub(n_nationkey, 3)", "k - 3"), ("div(n_nationkey, 4)", "k / 4"), ("mod(n_nationkey, 7)", "k % 7"), ("pow(n_nationkey, 2)", "k * k"), ("neg(n_nationkey + 1)", "-(k + 1)"), ("log10(100)", "2.0::DOUBLE"), ("int(n_nationkey / 2)", "floor(k / 2)"),
        ("len(n_name)", "strlen(s)::DOUBLE"), ("number(append('1', n_nationkey))", "('1' || n_nationkey)::DOUBLE"), ("catch(1 % 0) or 5", "5.0::DOUBLE"), ("json_from('{\"a\": 3}').a", "3.0::DOUBLE"), ("slice_init(1, n_nationkey)[1]", "k"),
        ("slice_cut([1, 2, 3], 1, 2).len()", "1.0::DOUBLE"), ("slice_new(2).len()", "2.0::DOUBLE"), ("range(3).len()", "3.0::DOUBLE"), ("get(made, 'a')", "k"), ("put[1]", "k"), ("gone.len()", "0.0::DOUBLE"), ("repeat(x => x * 2, 3)[2]", "4.0::DOUBLE"),
        ("count.get()", "k + 2"), ("rand(4).len()", "4.0::DOUBLE"), ("bytes('hi').len()", "2.0::DOUBLE"), ("orr(missing, 7)", "7.0::DOUBLE"), ("z * 2", "(k + 1) * 2"), ("go(x => 1 + 2).join()", "3.0::DOUBLE"), ("str_fields(n_name).len()", "len(string_split(s, ' '))::DOUBLE"),
    ),
    "string": (
        ("ternary(n_nationkey > 5, 'a', 'b')", "CASE WHEN k > 5 THEN 'a' ELSE 'b' END"), ("type(n_name)", "'string'"), ("join([n_name, 'x'], '-')", "s || '-x'"), ("str_join(['a', n_name], '+')", "'a+' || s"), ("str_to_upper('x' + n_name)", "upper('x' || s)"), ("str_to_lower(n_name)", "lower(s)"),
        ("str_trim('  x ')", "'x'"), ("str_split('a,b,c', ',', 2)[1]", "'b,c'"), ("sprintf('%d-%s', n_nationkey, n_name)", "n_nationkey || '-' || s"), ("built.string()", "s || '!'"), ("json_to([1, n_nationkey])", "'[1,' || n_nationkey || ']'"), ("base64_decode('aGk=').hex()", "'6869'"),
        ("hex_decode('6869').base64()", "'aGk='"), ("md5_sum(n_name).hex()", "md5(s)"), ("time_format(time_from_unix(86400 * n_nationkey), '2006-01-02')", "strftime(DATE '1970-01-01' + n_nationkey::INT, '%Y-%m-%d')"), ("failed.err", "'integer divide by zero'"),
        ("url_new_values().set('b', n_name).encode()", "'b=' || replace(s, ' ', '+')"), ("append('1', ['2', n_name]...)", "'12' || s"), ("said", "CASE WHEN n_nationkey = 5 THEN 'five' ELSE 'other' END"), ("hex_encode(hmac_sha256('data', 'key'))", "'5031fe3d989c6d1537a013fa6e739da23463fdaec3b70137d828e36ace221bd0'"),
    ),
    "boolean": (
        ("eq(n_nationkey, 5)", "k = 5"), ("neq(n_nationkey, 5)", "k <> 5"), ("eqs(n_nationkey, '5')", "k = 5"), ("neqs(n_nationkey, '5')", "k <> 5"), ("lt(n_nationkey, 5)", "k < 5"), ("lte(n_nationkey, 5)", "k <= 5"), ("gt(n_nationkey, 5)", "k > 5"), ("gte(n_nationkey, 5)", "k >= 5"),
        ("not(n_nationkey > 5)", "k <= 5"), ("is_empty(missing)", "true"), ("bool(n_nationkey)", "k <> 0"), ("boolean('true')", "true"), ("str_has_prefix(n_name, 'A')", "starts_with(s, 'A')"), ("str_has_suffix(n_name, 'A')", "suffix(s, 'A')"), ("regexp_new('^A.*A$').match(n_name)", "regexp_matches(s, '^A.*A$')"),
        ("time_now().year() > 2000", "true"), ("time_now_mill() > 1", "true"),
    ),
}, (
    "made = new()", "set(made, 'a', n_nationkey)", "gone = {a: 1}", "delete(gone, 'a')", "put = [1, 2]", "set_index(put, 1, n_nationkey)", "count = atomic_int(2)", "count.add(n_nationkey)", "built = str_builder()", "built.write(n_name, '!')", "failed = recoverd(1 % 0)",
    "n_nationkey + 1 as z", {"switch": "n_nationkey", "case": {"5": "said = 'five'"}, "default": "said = 'other'"},
))

program_query("r_methods", {
    "double": (
        ("n_name.bytes().len()", "strlen(s)::DOUBLE"), ("n_name.fields().len()", "len(string_split(s, ' '))::DOUBLE"), ("[n_nationkey].get(0)", "k"), ("[1, 2].clone().len()", "2.0::DOUBLE"), ("{a: 1}.set('b', 2).len()", "2.0::DOUBLE"), ("{a: 1}.delete('a').len()", "0.0::DOUBLE"), ("{a: n_nationkey}.get('a')", "k"),
        ("{a: n_nationkey}.clone().a", "k"), ("(n_nationkey * 3600).time().hour()", "k % 24"), ("(n_nationkey * 60).time().minute()", "k"), ("n_nationkey.time().second()", "k"), ("n_nationkey.time().unix_micro()", "k * 1000000"), ("n_nationkey.time().utc().year()", "1970.0::DOUBLE"),
        ("(n_nationkey + 5).time().sub(n_nationkey.time())", "5000.0::DOUBLE"), ("time_parse('2006-01-02', '2024-01-28').day()", "28.0::DOUBLE"), ("[n_nationkey].slice(0, 1).len()", "1.0::DOUBLE"),
    ),
    "string": (
        ("' x '.trim_space()", "'x'"), ("n_name.trim_left('A')", "ltrim(s, 'A')"), ("n_name.trim_right('A')", "rtrim(s, 'A')"), ("n_name.trim_prefix('AL')", "regexp_replace(s, '^AL', '')"), ("n_name.trim_suffix('IA')", "regexp_replace(s, 'IA$', '')"), ("n_name.to_lower()", "lower(s)"),
        ("n_name.json_str()", "'\"' || s || '\"'"), ("bytes('hi').copy().hex()", "'6869'"), ("n_name.base64().base64d().string()", "s"), ("[1, n_name].json_str()", "'[1,\"' || s || '\"]'"), ("{a: n_nationkey}.json_str()", "'{\"a\":' || n_nationkey || '}'"), ("n_nationkey.json_str()", "n_nationkey::VARCHAR"),
    ),
    "boolean": (("n_name.has_suffix('A')", "suffix(s, 'A')"), ("n_name.has('IN')", "contains(s, 'IN')"), ("n_name.has_prefix('A')", "starts_with(s, 'A')")),
})


# ---- fold -------------------------------------------------------------------------------


@query("SELECT max((props->>'$.k')::DOUBLE) + count(*) - 1 AS total FROM events")
def f_fold_in_order(spark, sf):
    """A step that depends on order, with `$idx` and a final expression."""
    rows = table(spark, sf, "events").select("event_id", F.col("props").alias("doc"))
    total = fold(rows, "doc", "most = most > $.k ? most : $.k; last = $idx", "most = 0; last = 0", "most + last", "event_id")
    return spark.createDataFrame([(total,)], "total double")


@query("SELECT (10 + sum((props->>'$.k')::DOUBLE)) * 2 AS total FROM events")
def f_fold_final(spark, sf):
    rows = table(spark, sf, "events").select(F.col("props").alias("doc"))
    return spark.createDataFrame([(fold(rows, "doc", "t += $.k", "t = 10", "t * 2"),)], "total double")
