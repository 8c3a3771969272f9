"""No task of a join gets a large part of the rows, as Spark's event log tells it."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shipcause.operators.spread import join_dimension, with_key

TOP = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("preset", ["model", "cli"])
def test_skewed_tables(preset):
    env = os.environ | {"PYTHONPATH": f"{TOP}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, str(TOP / "tests" / "skew_run.py"), preset], env=env, capture_output=True, text=True, timeout=600, check=True)
    found = json.loads(done.stdout.strip().splitlines()[-1])
    assert found["rows"][0] == 24_000 and found["rows"][1] == 24_000 and found["rows"][3] == 8_000
    assert len(found["stages"]) >= 4
    assert max(found["stages"].values()) < 0.15  # an even share is 1/16


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dimension_join_by_either_way(spark, no_broadcast):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    dim = spark.range(0, 3000, 2).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).unionByName(
        spark.createDataFrame([(1, None), (None, "never")], "k long, name string")
    )
    plain = sorted(tuple(r) for r in rows.join(dim, "k", "left").select("id", "k", F.coalesce("name", F.lit("-"))).fillna(-1).collect())
    for common in (1 / 200, 0.9, 0.0001):
        got = join_dimension(rows, dim, "k", rows, common).select("id", "k", F.coalesce("name", F.lit("-"))).fillna(-1).collect()
        assert sorted(tuple(r) for r in got) == plain


def test_rows_without_key(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (2, "d")], "k long, t string")
    right = spark.createDataFrame([(1, 10.0), (None, 5.0)], "k long, v double")
    got = with_key(rows, "k", lambda df: df.join(right, "k", "left")).orderBy("t").collect()
    assert [(r.k, r.t, r.v) for r in got] == [(1, "a", 10.0), (None, "b", None), (None, "c", None), (2, "d", None)]
    assert with_key(rows, "k", lambda df: df).count() == 4
