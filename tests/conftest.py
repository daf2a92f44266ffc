import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reclutark import schemas  # noqa: E402
from reclutark.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows of a stored table from dicts; columns that are left out are NULL."""

    def build(table, *rows):
        df = spark.createDataFrame([], schemas.TABLES[table])
        fields = df.schema.fields
        values = [tuple(_typed(row.get(f.name), f.dataType.simpleString()) for f in fields) for row in rows]
        return spark.createDataFrame(values, df.schema)

    return build


def _typed(value, kind):
    return day(value) if kind == "date" and isinstance(value, str) else value


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def value(spark):
    """Value of one expression over literals."""
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def tuples(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
