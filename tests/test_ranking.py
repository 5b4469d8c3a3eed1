"""Global places and exact percentiles by ranges: results and plan shapes."""

import math
import os
import random

import pytest
from conftest import AS_OF, SF001
from pyspark.sql import functions as F

from cspulse.operators.ranking import exact_percentiles, placed
from cspulse.plans import customer_health, ranked_list
from cspulse.session import release
from cspulse.sources.derive import fixture_tables


def order():
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


def test_places_equal_the_sorted_order(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([None, 1, 2, 2, 2, 5])) for i in range(700)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, score int").repartition(5)
    got = {r.id: r.place for r in placed(frame, order()).collect()}
    expected = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: at + 1 for at, (i, _) in enumerate(expected)}


def test_no_rows_have_no_places(spark):
    assert placed(spark.createDataFrame([], "id long, score int"), order()).count() == 0


def test_places_need_no_window_over_rows(spark):
    """One range shuffle of the rows, then a read of what it stored: no window, no single partition."""
    frame = spark.range(1000).selectExpr("id", "CAST(id % 7 AS INT) AS score")
    out = placed(frame, order())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "Exchange hashpartitioning" not in plan
    path = out.materialized_path
    assert os.path.isdir(path.removeprefix("file:"))
    release(out)
    assert not os.path.isdir(path.removeprefix("file:"))


def test_ranked_list_begins_with_the_limited_one(spark):
    cust, act = fixture_tables(spark, SF001)
    top = [r.customer_id for r in customer_health(cust, act, AS_OF, limit=10).collect()]
    everyone = ranked_list("customer_health", cust, act, AS_OF)
    assert [r.customer_id for r in everyone.where("place <= 10").orderBy("place").collect()] == top


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_exact_percentiles(spark, partitions):
    draw = random.Random(partitions)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(40)]) if n % 3 else 17)
            for n in range(900)] + [("empty", None), ("one", 5)]
    frame = spark.createDataFrame(rows, "g string, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.asDict() for r in exact_percentiles(frame, "g", "v", (1, 50, 90, 100)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        values = sorted(v for h, v in rows if h == g and v is not None)
        assert r["values"] == len(values)
        for p in (1, 50, 90, 100):
            assert r[f"p{p}"] == values[math.ceil(len(values) * p / 100) - 1], (g, p)
