import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from reclutark.llm.common import ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Extra columns whose names the operators use inside or give out.
CLASHES = ["token_ids", "score", "fp", "node", "row", "t", "w", "epoch", "leaf", "kept", "label", "h", "side", "place", "value", "component"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, folder=SMALL: spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) or longer tuples, with extra columns of clashing names."""

    def build(*rows, clashes=True):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        return df.selectExpr("*", *(f"'x' as `{c}`" for c in CLASHES)) if clashes else df

    return build


@pytest.fixture(scope="session")
def same(spark):
    """Holds a query's rows against its checking SQL."""

    def check(name, folder=SMALL, files=""):
        import __spark_entry__ as entry

        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{files}'")
        got = entry.queries()[name](spark, folder)
        want = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        left = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
        assert left == sorted(want.fetchall(), key=repr)
        return left

    return check
