"""Nulls in any column, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import audio, bpe, jaccard, langid, packing, quality, secrets, substring, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

RNG = random.Random(77)
LONG = " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(60_000)) + "\n" + "z" * 5000
ROWS = [
    (1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \n\t ", "de", None, 4), (4, "é 漢 😀", "en", "s", 5), (5, LONG, "en", "s", len(LONG)), (6, LONG, "de", "s", len(LONG)),
    (7, "same words in two rows of one id", "en", "s", 1), (7, "same words in two rows of one id", "en", "s", 1), (8, "same words in two rows of one id", "en", "s", 1),
    (None, "a text without an id", "en", "s", 1), (None, "a text without an id", "en", "s", 1), (None, None, None, None, None), (9, "token = abcdefghijklmnop " * 30, "en", "s", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    """documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS score", "'x' AS blob", "2 AS label", "3 AS bucket", "'y' AS cls", "4 AS spans", "5 AS tokens", "'w' AS words").repartition(4)


OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).select("doc_id", F.sha2("ids", 256).alias("a"), F.sha2("bytes", 256).alias("b")),
    "secrets": lambda d: secrets.digest((lambda v: secrets.findings(v, secrets.scan(v)))(secrets.versions_of(d))),
    "language": lambda d: langid.predict(d, langid.train(d)),
    "quality": lambda d: quality.judge(quality.measure(d)),
    "toxicity": lambda d: toxicity.score(d.select("doc_id", "text"), toxicity.train(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
    "substring": lambda d: substring.dedup(d),
    "jaccard": lambda d: jaccard.link(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_each_row_has_its_result(edges, name):
    out = OPERATORS[name](edges)
    found = sorted((tuple(None if c == "text" else r[c] for c in out.columns) for r in out.collect()), key=repr)
    assert len(found) == len(ROWS)
    at = out.columns.index("doc_id")
    of = lambda i: [r for r in found if r[at] == i]
    assert len(of(7)) == 2 and of(7)[0] == of(7)[1]  # repeated rows
    assert OPERATORS[name](edges.limit(0)).count() == 0
    if name == "jaccard":
        c = out.columns.index("component_id")
        assert {r[c] for i in (7, 8) for r in of(i)} == {7} and of(6)[0][c] == 5 and {r[c] for r in of(None)} == {None} and of(1)[0][1:] == (0, 1)
    if name == "bpe":
        assert len({of(5)[0][1], of(6)[0][1]}) == 1 and of(1)[0][1:] == of(2)[0][1:]
    if name == "language":
        assert {r[1] for i in (1, 2, 3) for r in of(i)} == {"und"}


def test_packing_of_edges(edges):
    out = packing.pack(edges, packing.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"), F.count("*").alias("k")).collect()
    found = {r.doc_id: r for r in out}
    assert found[1].n == found[2].n == 1 and found[5].n == found[5].m == found[6].n and found[7].n == 2 * found[7].m and set(found) == {r[0] for r in ROWS}
    assert packing.pack(edges.limit(0), packing.tokenizer_path()).count() == 0


def test_recordings_of_edges(edges):
    recordings = edges.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("audio"), F.lit(1).alias("fp"), "score")
    prints = audio.fingerprint(recordings, "pcm8").persist()
    assert prints.count() == len(ROWS)
    assert {(r.id, r.aligned_id) for r in audio.align(prints).collect()} == {(6, 5), (8, 7)}


@pytest.mark.parametrize("name,stage", pipeline.STAGES, ids=[n for n, _ in pipeline.STAGES])
def test_stages(spark, edges, tmp_path, name, stage):
    spark.createDataFrame([(i, None, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edges, edges.limit(0)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "packing":
            assert len({r.sequence_id for r in rows}) == len(rows)
            continue
        assert tuple(out.columns) == pipeline.COLUMNS
        if docs.isEmpty():
            assert not rows
            continue
        ids = sorted((r.doc_id for r in rows), key=repr)
        if name.startswith("n-gram"):  # of copies one row; the null text without an id stays, as does one row of the other
            assert ids == sorted([1, 2, 3, 4, 5, 7, 9, None, None], key=repr)
        elif name.startswith("substring"):
            kept = {r.doc_id: r.text for r in rows}
            assert kept[5] == LONG and 6 not in kept and kept[1] is None and len(kept[9].split()) < 90
        elif name.startswith("secret"):
            assert len(rows) == len(ROWS) and next(r.text for r in rows if r.doc_id == 9).count("[SECRET]") == 30
