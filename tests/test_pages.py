"""Large pages against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from clientele.operators import pages

ORDER = ("score DESC NULLS LAST", "kind DESC NULLS LAST", "id")


def rows(kind):
    rng = random.Random(7)
    draw = {
        "spread": lambda k: rng.random(), "ties": lambda k: float(rng.randrange(3)), "one": lambda k: 1.0,
        "skewed": lambda k: rng.random() ** 20 * 1e9, "nulls": lambda k: None if k % 3 else rng.random(),
    }[kind]
    return [(f"A{k}", draw(k), rng.randrange(5)) for k in range(3000)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "skewed", "nulls"])
def test_a_large_page_has_the_rows_of_the_sort(spark, kind):
    own = rows(kind)
    df = spark.createDataFrame(own, "id string, score double, kind int")
    ordered = sorted(own, key=lambda r: (r[1] is None, -(r[1] or 0), -r[2], r[0]))
    order = [F.col("score").desc_nulls_last(), F.col("kind").desc_nulls_last(), F.col("id").asc()]
    for limit in (400, 2999, 5000):
        got = pages.first_rows(df, order, limit, "score", one_task_rows=100)
        assert {r.id for r in got.collect()} == {r[0] for r in ordered[:limit]} and got.columns == df.columns
    got = pages.first_rows(df, order, 90, "score", one_task_rows=100)
    assert [r.id for r in got.collect()] == [r[0] for r in ordered[:90]]


def test_without_a_score_and_without_rows(spark):
    df = spark.range(1000).select(F.format_string("C%05d", "id").alias("customer_id"))
    got = pages.first_rows(df, [F.col("customer_id")], 500, one_task_rows=10)
    assert {r.customer_id for r in got.collect()} == {f"C{k:05d}" for k in range(500)}
    assert pages.first_rows(df.limit(0), [F.col("customer_id")], 500, one_task_rows=10).collect() == []
    with pytest.raises(ValueError):
        pages.first_rows(df, [F.col("customer_id")], -1)


def test_only_the_last_range_is_sorted(spark, monkeypatch):
    """Of the ranges that are stored, a single one is cut by a top-k."""
    monkeypatch.setattr(pages, "stored", lambda df, name: df.drop("_range").repartition(8, "id").withColumn("_range", F.floor((1 - F.col("score")) * 8)))
    df = spark.range(10_000).select(F.col("id").cast("string").alias("id"), (F.col("id") / 10_000).alias("score"))
    page = pages.first_rows(df, [F.col("score").desc(), F.col("id")], 5_100, one_task_rows=1000)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GlobalLimit") == 1 and page.count() == 5_100
