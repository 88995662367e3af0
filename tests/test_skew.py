from pyspark.sql import functions as F

from clientele.operators.skew import join_profiles


def test_hot_and_missing_keys_are_split_and_nothing_is_lost(spark):
    rows = spark.range(12000).select(
        F.concat(F.lit("A"), "id").alias("action_id"),
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, F.concat(F.lit("C"), (F.col("id") % 500).cast("string"))).alias("k"),
    )
    profiles = spark.range(400).select(F.concat(F.lit("C"), "id").alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("HOT", -1)], "k string, v bigint")
    )
    got = join_profiles(rows, profiles, "k", "action_id", hot_rows=100)
    assert got.columns == ["k", "action_id", "v"]
    plain = rows.join(profiles, "k", "left").select("k", "action_id", "v")
    assert got.count() == 12000 and got.exceptAll(plain).count() == 0


def test_a_hot_key_meets_many_partitions(spark):
    before = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    rows = spark.range(8000).select(F.concat(F.lit("A"), "id").alias("action_id"), F.lit("HOT").alias("k"))
    profiles = spark.createDataFrame([("HOT", 1)], "k string, v int")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = join_profiles(rows, profiles, "k", "action_id", hot_rows=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 8000 and len(sizes) > 1 and max(sizes) < 5000
