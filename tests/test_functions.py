from pyspark.sql import functions as F

from clientele.functions import (
    clamp, discount_code, first_word, fixed_text, half_even, money_text, percent_text, short_money, stable_sum, whole_days,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_even_ties(spark):
    got = [one(spark, half_even(F.lit(x), 2)) for x in (0.125, 0.375, 1.005, -0.125)]
    assert got == [0.12, 0.38, 1.0, -0.12]
    assert one(spark, half_even(F.lit(2.5))) == 2.0


def test_clamp_keeps_null(spark):
    assert one(spark, clamp(F.lit(None).cast("double"), 0.0, 100.0)) is None
    assert one(spark, clamp(F.lit(120.0), 0.0, 100.0)) == 100.0


def test_whole_days_counts_full_periods_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)

            def days(start, end, **kw):
                return one(spark, whole_days(F.lit(start).cast("timestamp_ntz"), end, **kw))

            assert days("2024-03-09 23:00:00", "2024-03-10 01:00:00") == 0
            assert days("2024-03-09 12:00:00", "2024-03-11 12:00:00") == 2
            assert days("2024-03-11 00:00:01", "2024-03-11 00:00:00") == -1
            assert days("2024-03-12 00:00:00", "2024-03-11 00:00:00") == -1
            assert days("2024-03-12 00:00:00.000001", "2024-03-11 00:00:00") == -2
            assert days("2024-03-11 12:00:00", "2024-03-11 00:00:00", toward_zero=True) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_texts(spark):
    assert one(spark, percent_text(F.lit(0.91))) == "91%"
    assert one(spark, percent_text(F.lit(0.125))) == "12%"
    assert one(spark, fixed_text(F.lit(0.125), 2)) == "0.12"
    assert one(spark, money_text(F.lit(1234567.5))) == "$1,234,568"
    assert one(spark, first_word(F.lit("  Ada  Lovelace"))) == "Ada"
    assert one(spark, first_word(F.lit("   "))) is None
    assert one(spark, discount_code(F.lit(20), F.lit("c00ab12"))) == "SAVE20-AB12"
    assert [one(spark, short_money(F.lit(x))) for x in (1834609.85, 76099.99, 12.0)] == ["$1.83M", "$76.1K", "$12"]


def test_stable_sum_ignores_order(spark):
    values = [0.1, 0.2, 0.3, 1e6, -1e6] * 50
    frames = [spark.createDataFrame([(v,) for v in vs], "v double").repartition(n) for vs, n in ((values, 3), (values[::-1], 7))]
    assert len({f.agg(stable_sum(F.col("v"))).first()[0] for f in frames}) == 1
