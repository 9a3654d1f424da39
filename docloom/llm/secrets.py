"""Secret scans over an incremental blob ledger, on DataFrame functions alone.

Every historical version of a path is content-addressed: its blob is the SHA-256 of its
text. The ledger holds one row for each blob and rule version that was scanned, with the
spans found (none: an empty list). A scan takes the blobs of new versions once each,
leaves out the pairs that the ledger knows, evaluates the rest natively, and joins the
findings back to all paths. A changed pattern is a new rule version, so only that rule
is scanned again. `update` keeps the ledger as a table at a path, to which it appends what is new.

Spans are code points, end exclusive: a pattern's gaps (`split`) and matches
(`regexp_extract_all`) give lengths whose running sums are the places. Copies of a blob
are reduced before the shuffle, so a hot blob sends one row for each task; paths of a hot blob are dealt over
salts where findings are joined back. Spans are put together by runs of CHUNK, so that their number costs
little more than in proportion. A null text counts
as empty, a null path keeps its row, repeated rows give repeated findings, other columns are
ignored, an empty table gives no rows. One text is one value, however long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import _hadoop, drop, hot_keys, join_spread, materialise, shared_dir, table

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"
#: Items that are appended to one array at a time; the setting that names a ledger to keep between runs.
CHUNK, LEDGER_CONF = 256, "spark.docloom.secrets.ledger"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        text = f"{self.pattern}\n{self.group}\n{self.least}"
        return f"{self.kind}@{hashlib.sha256(text.encode()).hexdigest()[:12]}"


# The base rules; runs of a single class with a least length are written as such,
# which finds the same spans.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
)
#: What this method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = (*BASE, *MORE)


def gathered(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """What a fold over `items` puts into an array and its last state; `step` gives the next state, whether to put something, and what."""

    def fold(part: Column, at: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            state, some, value = step(acc["at"], x)
            return F.struct(state.alias("at"), F.when(some, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def chunk(acc: Column, first: Column) -> Column:
        return F.transform(F.array(fold(F.slice(items, first, CHUNK), acc["at"])), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), chunk)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule in a text."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    steps = F.zip_with(
        F.slice(F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g)), 1, F.size(matches)),
        F.zip_with(matches, checked, lambda m, c: F.struct(F.length(m).alias("n"), (F.length(c) >= rule.least).alias("good"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["good"].alias("good")),
    )
    none = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        a = at + s["gap"]
        return a + s["n"], s["good"], F.struct(a.alias("start"), F.lit(rank).alias("rank"), (a + s["n"]).alias("end"), F.lit(rule.kind).alias("kind"))

    return F.when(text.rlike(rule.pattern), gathered(steps, F.lit(0), SPAN, step)["out"]).otherwise(none)


def versions_of(rows: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob and text of each row."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.select(F.col(path).alias("path"), F.sha2(whole.cast("binary"), 256).alias("blob"), whole.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The new ledger rows: pairs of blobs in `versions` and rules that `ledger` lacks."""
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("known", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        blobs = blobs.where(~F.forall(F.array(*[F.lit(r.version) for r in rules]), lambda v: F.array_contains("known", v)))
    text = F.col("text")
    found = [
        F.when(~F.array_contains("known", r.version), F.struct(F.lit(r.version).alias("rule"), spans_of(text, r, k).alias("spans")))
        for k, r in enumerate(rules)
    ]
    pairs = blobs.select("blob", F.explode(F.array(*found)).alias("pair")).where("pair IS NOT NULL")
    return materialise(pairs.select("blob", "pair.rule", "pair.spans"), "ledger")


def ledger_at(spark, path: str) -> DataFrame | None:
    """The ledger kept at a path, if there is one."""
    system, where = _hadoop(spark, path)
    return spark.read.schema(LEDGER).parquet(path) if system.exists(where) else None


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at a path lacks, append it there, and return the whole ledger."""
    spark = versions.sparkSession
    new = scan(versions, ledger_at(spark, path), rules)
    new.write.mode("append").parquet(path)
    drop(new)
    return ledger_at(spark, path)


def blob_spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its spans, by start and then rule order, of blobs that have any."""
    wanted = ledger.where(F.col("rule").isin([r.version for r in rules]) & (F.size("spans") > 0))
    return wanted.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path and its spans, by start and then rule order, of every version."""
    paths = materialise(versions.select("path", "blob"), "paths")
    joined = join_spread(paths, blob_spans(ledger, rules), "blob", "path", hot_keys(paths, "blob"), "left")
    return joined.select("path", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced."""

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["end"]), s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))

    whole = F.transform(F.array(gathered(spans, F.lit(0), "string", step)), lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))[0]
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """By the ledger that LEDGER_CONF names, which later runs add to; else by one of this run's own."""
    versions = versions_of(table(spark, sf_dir, "documents"))
    path = spark.conf.get(LEDGER_CONF, None)
    if not path:
        path = f"{shared_dir(spark)}/docloom-ledger-{uuid.uuid4().hex}"
        system, where = _hadoop(spark, path)
        system.deleteOnExit(where)
    return digest(findings(versions, update(versions, path)))
