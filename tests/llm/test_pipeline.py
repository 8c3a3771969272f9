"""The pipeline, stage by stage, and the registered queries with SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from checks.compare import database, difference, duckdb_rows, spark_rows
from shipcause.llm.common import table
from shipcause.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "encoding"]
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, SMALL)), duckdb_rows(database(SMALL), ORACLES[name])) is None


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    labels = {r.doc_id: r for r in table(spark, FOLDER, "labels").collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, corpus_pipeline.kept(stage(spark, docs, FOLDER), name)
        assert docs.columns == before.columns
        ids, old = [r.doc_id for r in docs.select("doc_id").collect()], {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= old and (name == "mixing" or len(ids) == len(set(ids)))
        sizes.append(len(ids))
        gone = old - set(ids)
        if name == "quality":
            assert all(labels[i].quality == 0 for i in gone & labels.keys()) and len(gone & labels.keys()) > 30
        if name == "toxicity":
            assert sum(labels[i].toxic for i in gone & labels.keys()) > 0.9 * len(gone & labels.keys())
            clean = [i for i in old if i in labels and not labels[i].toxic]
            assert sum(i in gone for i in clean) < 0.02 * len(clean)
    assert 0 < sizes[2] < sizes[1] < sizes[0] < 1000


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 20
    assert corpus_pipeline.ORACLE_SQL is None


def test_entry_needs_no_session():
    """The entry points can be imported before any Spark session exists."""
    code = "import __spark_entry__ as e; assert 'pipeline' in e.queries() and 'op8_minhash_join' in e.oracle_sql()"
    top = Path(corpus_pipeline.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_no_documents(spark, odd_docs, no_docs, stage):
    """NULLs, empty and long texts, repeated rows and clashing columns go through every stage, as do no rows."""
    ids = {r.doc_id for r in odd_docs.collect()}
    out = stage(spark, odd_docs, FOLDER)
    if stage is not corpus_pipeline.encoded:
        assert out.columns == odd_docs.columns and stage(spark, no_docs, FOLDER).columns == odd_docs.columns
    else:
        assert out.count() == odd_docs.count()
    assert {r.doc_id for r in out.collect()} <= ids
    assert stage(spark, no_docs, FOLDER).collect() == []
