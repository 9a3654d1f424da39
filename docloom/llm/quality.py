r"""Quality rules: a threshold table compiled into one Spark projection.

Counts come from built-in functions only; a rule is a row (name, left, factor, comparison, right):
it rejects a document when `factor * left` compares so with `right`, integers throughout,
so no ratio is rounded. Repeated three-word windows are found by sorting one packed long
for each window (38 bits of hash, 26 of place) and comparing neighbours as words. Where two neighbours have one
hash and differ, or places do not fit, the text's windows are sorted by their words instead, so that nothing hides
between two equal ones.

One pass, no shuffle. A null text has no words and fails the base; repeated rows are judged alike,
a null doc_id stays null, other columns are ignored, an empty table gives no rows. One text is one value,
however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the and of to in is it that was for on with as this be at by are from or der die das und in den von zu mit ist ein eine auf für im le la les de des et en un une du que qui pour dans sur par pas el los las y que se con por una es del al lo".split()
STOP_WORDS = sorted(set(STOP_WORDS))

#: name, left count, factor, comparison, right: a Gopher-like table; right is a count times a number.
THRESHOLDS = (
    ("few_words", "n_words", 1, "<", "50"),
    ("repeated_words", "n_repeat_words", 100, ">", "50 * n_words"),
    ("short_words", "word_chars", 10, "<", "25 * n_words"),
    ("long_words", "word_chars", 1, ">", "14 * n_words"),
    ("symbols", "n_symbols", 10, ">", "5 * n_words"),
    ("stop_words", "n_stop_words", 100, "<", "2 * n_words"),
    ("duplicate_lines", "n_dup_lines", 100, ">", "30 * n_lines"),
    ("bullet_lines", "n_bullet_lines", 100, ">", "90 * n_lines"),
    ("ellipsis_lines", "n_ellipsis_lines", 100, ">", "30 * n_lines"),
)
BASE = ("few_words", "repeated_words")


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


PLACE_BITS = 26


def hash_of(*words: Column) -> Column:
    return F.xxhash64(*words)


def _windows(words: Column, of) -> Column:
    """of(word, place) at each three-word window, sorted."""
    return F.when(F.size(words) > 2, F.sort_array(F.slice(F.transform(words, of), 1, F.greatest(F.size(words) - 2, F.lit(1)))))


def _packed(words: Column) -> Column:
    """One sorted long for each three-word window."""
    code = lambda w, i: F.shiftleft(F.shiftrightunsigned(hash_of(w, F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))
    return F.coalesce(_windows(words, code), F.array().cast("array<bigint>"))


def _repeated(words: Column, packed: Column) -> Column:
    """Sorted places of the windows that are found twice or more."""
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    word = lambda i, k: F.get(words, i + k)
    exact = lambda x, y: (word(place(x), 0) == word(place(y), 0)) & (word(place(x), 1) == word(place(y), 1)) & (word(place(x), 2) == word(place(y), 2))
    hashes = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)

    def same(x: Column, y: Column) -> Column:
        return F.when(hashes(x, y), exact(x, y)).otherwise(F.lit(False))

    def marked(items: Column, alike) -> Column:
        return F.filter(items, lambda x, i: F.coalesce(F.when(i > 0, alike(x, F.get(items, i - 1))), F.lit(False)) | F.coalesce(alike(x, F.get(items, i + 1)), F.lit(False)))

    clash = F.exists(F.filter(packed, lambda x, i: F.when(hashes(x, F.get(packed, i + 1)), ~exact(x, F.get(packed, i + 1))).otherwise(F.lit(False))), lambda x: F.lit(True))
    whole = lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("i"))
    by_words = F.transform(F.array(_windows(words, whole)), lambda items: F.transform(marked(items, lambda x, y: x["t"] == y["t"]), lambda x: x["i"]))[0]
    fits = F.size(words) < (1 << PLACE_BITS)
    return F.sort_array(F.when(fits & ~clash, F.transform(marked(packed, same), place)).otherwise(by_words))


def _covered(places: Column) -> Column:
    """Words in the windows at the sorted places."""
    return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the counts that rules speak of."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    split = rows.select(
        "doc_id",
        F.array_remove(F.split("text", f"[{SPACE}]+", -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
    )
    packed = split.withColumn("packed", _packed(F.col("words")))
    marked = packed.withColumn("places", _repeated(F.col("words"), F.col("packed")))
    bare = lambda w: F.translate(F.lower(w), ".,;:!?", "")
    return marked.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: bare(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def judge(measured: DataFrame, thresholds=THRESHOLDS, base=BASE) -> DataFrame:
    """The counts with base_failed, kept and `reasons`, the names of the rules that reject."""
    tests = {name: F.expr(f"{factor} * {left} {op} {right}") for name, left, factor, op, right in thresholds}
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return measured.withColumn("reasons", reasons).withColumns({
        "base_failed": F.arrays_overlap("reasons", F.array(*map(F.lit, base))),
        "kept": F.size("reasons") == 0,
    })


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(measure(table(spark, sf_dir, "documents"))).select(*COLUMNS)


def _oracle() -> str:
    fails = {name: f"{factor} * {left} {op} {right}" for name, left, factor, op, right in THRESHOLDS}
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: regexp_replace(lower(x), '[.,;:!?]', '', 'g') IN ({stop})))::BIGINT AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(f"({fails[b]})" for b in BASE)} AS base_failed, NOT ({" OR ".join(f"({f})" for f in fails.values())}) AS kept FROM m
"""


ORACLE = _oracle()
