import os
import re

import duckdb
import pytest

from docloom.llm import jaccard, packing, secrets, substring
from docloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        n = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
        assert len({r[columns.index("doc_id")] for r in rows}) == n
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_pipeline_stages(spark, duck):
    """Each stage by brute force on what the stage before it gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert name == "packing" or tuple(out.columns) == pipeline.COLUMNS
        after = {r.doc_id: r.text for r in out.collect()} if name != "packing" else None
        if name == "toxicity":
            assert set(after) < set(before) and all(before[i] == t for i, t in after.items())
        elif name.startswith("n-gram"):
            links = {r.doc_id: r.component_id for r in jaccard.link(docs).collect()}
            assert set(after) == set(links.values()) and len(after) < len(before)
        elif name.startswith("substring"):
            cut = {r.doc_id: r for r in substring.dedup(docs).collect()}
            assert set(after) == {i for i, r in cut.items() if not r.n_removed or r.n_removed < r.n_words}
            assert all(t == (cut[i].kept if cut[i].n_removed else before[i]) for i, t in after.items())
        elif name.startswith("secret"):
            assert set(after) == set(before)
            rule = secrets.BASE[0]
            for i, t in after.items():
                found = [m for m in re.compile(rule.pattern, re.A).finditer(before[i] or "") if len(m[2]) >= rule.least]
                assert ("[SECRET]" in (t or "")) >= bool(found) and not re.search("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", t or "")
        else:
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == set(before) and all(len(r.ids) == 4 * r.length <= 4 * packing.SIZE for r in pieces)
            kept = {r.doc_id for r in pieces}
        if name != "packing":
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert kept and {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == kept
