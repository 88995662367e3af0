"""Run every registered query next to its SQL twin and compare schema kinds, row counts and values.

    python -m checks.compare [sf_dir] [query ...]
"""

import sys
import time
import warnings

import duckdb
import pandas as pd

from checks.oracle_sql import ORACLE_SQL
from clientele.queries import QUERIES
from clientele.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(dtype: str) -> str:
    """Names of the same type in both engines."""
    dtype = dtype.lower()
    return {"string": "varchar", "int": "integer"}.get(dtype, dtype)


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple("NULL" if v is None or v is pd.NA or v != v else repr(v.item() if hasattr(v, "item") else v) for v in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """An empty text if both agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    ours_types = {n: _kind(t) for n, t in df.dtypes}
    ours = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    if name not in ORACLE_SQL:
        return "" if len(ours) else "no rows"
    cursor = con.execute(ORACLE_SQL[name])
    their_types = {d[0]: _kind(str(d[1])) for d in cursor.description}
    theirs = pd.DataFrame(cursor.fetchall(), columns=list(their_types), dtype=object)
    if set(ours_types) != set(their_types):
        return f"columns {sorted(set(ours_types) ^ set(their_types))}"
    wrong = {n: (ours_types[n], their_types[n]) for n in ours_types if ours_types[n] != their_types[n]}
    if wrong:
        return f"types {wrong}"
    a, b = _rows(ours), _rows(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}" if bad else ""


def main() -> int:
    warnings.simplefilter("ignore")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(verdict)
        mode = "twin" if name in ORACLE_SQL else "rows"
        print(f"{'FAIL' if verdict else 'ok':5}{mode:5}{time.time() - start:7.2f}s  {name}  {verdict}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
