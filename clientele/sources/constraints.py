"""Key, uniqueness and reference checks as one report."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.schemas import FACT_TABLES, PRIMARY_KEYS


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per declared constraint with the count of violating rows.

    All unique columns are counted together per (rule, value), and all references
    per (rule, customer) before they meet the customers once; copies of a value and
    the facts of one customer merge map-side.
    """
    unique = [(f"{name}.{key} unique", name, key) for name, key in PRIMARY_KEYS.items() if name in tables]
    unique.append(("customers.email unique", "customers", "email"))
    references = [(f"{name}.customer_id exists", name, "customer_id") for name in FACT_TABLES if name in tables]

    def counted(checks):
        stacked = reduce(
            DataFrame.unionByName,
            [tables[t].select(F.lit(rule).alias("rule"), F.col(c).alias("value")) for rule, t, c in checks],
        )
        return stacked.filter("value IS NOT NULL").groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n"))

    repeats = counted(unique).filter("n > 1").select("rule", (F.col("n") - 1).alias("violations"))
    known = tables["customers"].select(F.col("customer_id").alias("value"))
    orphans = counted(references).join(known, "value", "left_anti").select("rule", F.col("n").alias("violations"))
    clean = tables["customers"].sparkSession.createDataFrame(
        [(rule, 0) for rule, _, _ in (*unique, *references)], "rule string, violations bigint"
    )
    found = clean.unionByName(repeats).unionByName(orphans)
    return found.groupBy("rule").agg(F.sum("violations").alias("violations"))
