import pytest
from pyspark.sql import functions as F

from clientele.schemas import TABLES
from clientele.session import shared_dir
from clientele.sources import sinks
from clientele.sources.constraints import check_constraints
from clientele.sources.driver_tables import crm_tables
from clientele.sources.merge import last_per_key, upsert_by_key
from clientele.sources.tables import conform, load_table, load_tables
from tests.conftest import SF_DIR


def test_conform_adds_columns_once(spark):
    old = spark.createDataFrame([("1", "A", "x")], "action_id string, customer_id string, extra string")
    first = conform(old, TABLES["agent_actions"])
    assert first.columns == [*TABLES["agent_actions"].names, "extra"]
    assert conform(first, TABLES["agent_actions"]).collect() == first.collect()
    assert first.schema["urgency_score"].dataType.typeName() == "double"


def test_constraints_on_mapped_tables(spark):
    report = check_constraints(crm_tables(spark, SF_DIR)).collect()
    assert len(report) == 14 and all(r["violations"] == 0 for r in report)


def test_constraints_find_damage(spark, frame):
    tables = {
        "customers": frame("customers", [dict(customer_id="A", email="x"), dict(customer_id="B", email="x"), dict(customer_id="B", email=None)]),
        "transactions": frame("transactions", [dict(txn_id="1", customer_id="Z"), dict(txn_id="1", customer_id="Z"), dict(txn_id="2", customer_id=None)]),
    }
    got = {r["rule"]: r["violations"] for r in check_constraints(tables).collect()}
    assert got == {"customers.customer_id unique": 1, "transactions.txn_id unique": 1, "customers.email unique": 1,
                   "transactions.customer_id exists": 2}


def test_upsert_last_one_wins_with_hot_key(spark):
    base = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    copies = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("N"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id").cast("int").alias("v"), F.col("id").alias("seq"),
    )
    got = {r["k"]: r["v"] for r in upsert_by_key(base, copies, ["k"], "seq").collect()}
    assert got["A"] == 8997 and got["B"] == 2 and len(got) == 52
    tied = copies.withColumn("seq", F.lit(1)).repartition(5)
    assert {r["v"] for r in last_per_key(tied, ["k"], "seq").filter("k = 'A'").collect()} == {8997}
    plan = last_per_key(copies, ["k"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(" in plan and "Window" not in plan


def test_files_round_trip(spark, tmp_path):
    tables = crm_tables(spark, SF_DIR)
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/parquet/{name}")
        df.write.json(f"{tmp_path}/json/{name}")
    for fmt in ("parquet", "json"):
        read = load_tables(spark, f"{tmp_path}/{fmt}", fmt)
        for name, df in tables.items():
            assert read[name].schema.names == TABLES[name].names and read[name].count() == df.count()


def test_rebuild_leaves_no_old_rows(spark, frame, tmp_path):
    folder = str(tmp_path)
    sinks.write_tables(crm_tables(spark, SF_DIR, ["customers", "email_log"]), folder)
    sinks.write_tables({"customers": frame("customers", [dict(customer_id="A")])}, folder)
    read = load_tables(spark, folder)
    assert {n: df.count() for n, df in read.items()} == {n: int(n == "customers") for n in TABLES}


def test_pruning_reaches_the_scan(spark):
    plan = crm_tables(spark, SF_DIR)["support_tickets"].select("customer_id", "sentiment_score")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "PushedFilters: [IsNotNull(l_returnflag)" in plan


def test_predictions_are_replaced(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_predictions(frame("ml_predictions", [dict(prediction_id=str(i), customer_id=str(i)) for i in range(5)]), path)
    sinks.write_predictions(frame("ml_predictions", [dict(prediction_id="9", customer_id="9")]), path)
    assert [r["customer_id"] for r in spark.read.parquet(path).collect()] == ["9"]


class FakeSession:
    """What the folder lookup asks of a session."""

    def __init__(self, folder, master):
        self.folder, self.master, self.applicationId = folder, master, f"fake-{master}"
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_the_configured_one():
    assert shared_dir(FakeSession("hdfs://x/y", "yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None, "yarn"))
    local = FakeSession(None, "local[2]")
    assert shared_dir(local) == shared_dir(local)


@pytest.mark.parametrize("name", list(TABLES))
def test_mapped_schema(spark, name):
    mapped = crm_tables(spark, SF_DIR, [name])[name]
    assert [(f.name, f.dataType) for f in mapped.schema.fields] == [(f.name, f.dataType) for f in TABLES[name].fields]


def test_csv_is_read_by_name_and_bad_cells_are_errors(spark, tmp_path):
    folder = tmp_path / "transactions"
    folder.mkdir()
    (folder / "a.csv").write_text("customer_id,amount,txn_id,note\nC1,5.5,T1,x\nC2,,T2,y\n")
    (folder / "b.csv").write_text("customer_id,amount,txn_id,note\nC3,7,T3,z\n")
    rows = {r["txn_id"]: r for r in load_table(spark, str(tmp_path), "transactions", "csv", header="true").collect()}
    assert {k: (r["customer_id"], r["amount"], r["txn_date"], r["note"]) for k, r in rows.items()} == {
        "T1": ("C1", 5.5, None, "x"), "T2": ("C2", None, None, "y"), "T3": ("C3", 7.0, None, "z"),
    }
    (folder / "b.csv").write_text("customer_id,amount,txn_id,note\nC3,\"5,0x\",T3,z\n")
    with pytest.raises(Exception, match="column amount: no double: 5,0x"):
        load_table(spark, str(tmp_path), "transactions", "csv", header="true").collect()
