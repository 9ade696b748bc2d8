"""What the plans of large tables must look like."""

import re

import pytest

from standflow.operators import examples as ex
from standflow.plans.extraction import extract_examples


@pytest.fixture
def timeline(spark, tmp_path):
    rows = [(u, s, y, "AB"[(y // 3 + s) % 2]) for u in (1, 2, None) for s in (0, 1) for y in range(40)]
    df = spark.createDataFrame(rows, "u int, s int, y int, state string")
    df.write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffles(df):
    """Keys of each exchange, without those that are used again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan)


def of_rows(df):
    return [s for s in shuffles(df) if "__block" in s]


@pytest.mark.parametrize("make", [
    lambda t: ex.residence_time(t, ["u", "s"], "y", "state"),
    lambda t: ex.target_time(t, ["u", "s"], "y", "state"),
    lambda t: ex.example_flag(t, ["u", "s"], "y", "state"),
    lambda t: extract_examples(t, ["u", "s"], "y", "state"),
])
def test_rows_of_a_timeline_keep_their_partitioning(timeline, sorted_joins, make):
    keys = of_rows(make(timeline))
    # rows by key and block; summaries, one row a block, are dealt anew to meet them
    assert len({re.sub(r"#\d+", "", k) for k in keys}) == 1, keys
    assert not [k for k in keys if "coalesce" in k or "isnull" in k]
