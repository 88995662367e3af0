"""Features from daily partials against the full build."""

import pytest
from pyspark.sql import functions as F

from clientele.operators import daily
from clientele.operators.features import build_customer_features
from clientele.sources.driver_tables import crm_tables
from tests.conftest import SF_DIR

NAMES = ("customers", "transactions", "engagement_events", "support_tickets", "email_log")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return {name: df.cache() for name, df in crm_tables(spark, SF_DIR, NAMES).items()}


@pytest.mark.parametrize("as_of", ["2024-02-10 00:00:00", "2024-02-03 13:37:11"])
def test_any_time_gives_what_the_full_build_gives(spark, tables, tmp_path, as_of):
    daily.write_daily(tables, str(tmp_path))
    got = daily.features_from_daily(spark, tables["customers"], tables["engagement_events"], str(tmp_path), as_of)
    expected = build_customer_features(tables, as_of)
    assert got.columns == expected.columns and rows(got) == rows(expected)


def test_late_and_removed_rows_rewrite_their_days(spark, tables, tmp_path):
    days = ["2024-01-05", "2024-01-06"]
    on = {fact: F.to_date(time).cast("string").isin(*days) for fact, time in daily.DAYS.items()}
    daily.write_daily({**tables, **{f: tables[f].filter(~on[f] | (F.crc32(tables[f].columns[0]) % 2 == 0)) for f in on}}, str(tmp_path))
    for changed in (tables, {**tables, **{f: tables[f].filter(~on[f]) for f in on}}):
        daily.write_daily(changed, str(tmp_path), days)
        got = daily.features_from_daily(spark, tables["customers"], changed["engagement_events"], str(tmp_path), "2024-02-01 06:00:00")
        assert rows(got) == rows(build_customer_features(changed, "2024-02-01 06:00:00"))


def test_only_one_day_of_the_events_is_read(spark, tables, tmp_path):
    daily.write_daily(tables, str(tmp_path))
    stored = str(tmp_path / "events")
    tables["engagement_events"].withColumn("d", F.to_date("event_date")).write.partitionBy("d").parquet(stored)
    events = spark.read.parquet(stored)
    cut = events.filter(F.col("d") == "2024-01-02")
    ask = lambda e: rows(daily.features_from_daily(spark, tables["customers"], e, str(tmp_path), "2024-02-01 06:00:00"))
    assert ask(events) == ask(cut)
