import pytest
from pyspark.sql import functions as F

from clientele.operators import scoring as sco


def labels(spark, function, *scores):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    return [r[0] for r in df.select(function(F.col("s"))).collect()]


def test_label_cuts(spark):
    assert labels(spark, sco.churn_label, 0.0, 0.3, 0.30001, 0.6, 0.60001, 1.0, None) == [None, "Low", "Medium", "Medium", "High", "High", None]
    assert labels(spark, sco.conversion_label, 0.0, 0.35, 0.36, 0.65, 0.66) == [None, "Cold", "Warm", "Warm", "Hot"]
    assert labels(spark, sco.risk_band, 0.2999, 0.3, 0.6) == ["Low", "Medium", "High"]
    assert labels(spark, sco.conversion_band, 0.3999, 0.4, 0.7) == ["Cold", "Warm", "Hot"]


def test_cluster_names_stay_distinct_on_ties(spark):
    rows = [(f"C{i}", i % 5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "customer_id string, cluster int, recency double, frequency double, monetary double,"
                                     " engagement double, health double, tenure double")
    names = {r["cluster"]: r["segment"] for r in sco.profile_clusters(df).collect()}
    assert names == {0: "Champion", 1: "Loyal", 2: "At-Risk", 3: "Prospect", 4: "Lost"}


def test_confidence(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (1.5, 2.0)], "x double, y double")
    got = [r[0] for r in df.select(sco.segment_confidence([F.col("x"), F.col("y")], [[0, 0], [3, 4]])).collect()]
    assert got == [1.0, 1.0, 0.0]


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.1), (0, 0.8), (0, 0.2)], "y int, s double")
    rows = {r["class"]: r for r in sco.classification_report(df, "y", "s").collect()}
    assert rows[1]["precision"] == pytest.approx(2 / 3, abs=1e-6) and rows[1]["recall"] == pytest.approx(2 / 3, abs=1e-6)
    assert (rows[0]["precision"], rows[0]["recall"], rows[0]["support"]) == (0.5, 0.5, 2)


def test_report_of_a_class_never_called(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, s double")
    rows = {r["class"]: r for r in sco.classification_report(df, "y", "s").collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["f1"]) == (0.0, 0.0, 0.0)
