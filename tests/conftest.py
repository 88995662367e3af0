import datetime as dt

import pytest

from clientele.schemas import TABLES
from clientele.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows (dicts) as a DataFrame of a table; missing columns are null, a missing key is the row's place."""

    def build(table, rows):
        schema = TABLES[table]
        rows = [{schema.names[0]: str(n), **row} for n, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return build


def at(day, hour=0, minute=0, second=0, month=1):
    return dt.datetime(2024, month, day, hour, minute, second)


AS_OF = "2024-02-10 00:00:00"
