"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_points  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LLM = re.compile(r"op\d+_.*|pipeline")
NAMES = [n for n in entry_points.queries() if not LLM.fullmatch(n)]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    sql = entry_points.oracle_sql()[name]
    names = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(tuple(map(shown, r)) for r in duck.sql(f"SELECT {names} FROM ({sql})").fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry_points.oracle_sql())


def test_no_query_is_vacuous(duck):
    """Every query's SQL has rows, on the tables that results are compared on if they are there."""
    sf = Path("/root/testdata/sf0.01")
    if sf.is_dir():
        import duckdb

        duck = duckdb.connect()
        duck.sql("SET timezone = 'UTC'")
        for p in sf.glob("*.parquet"):
            duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = entry_points.oracle_sql()
    assert [n for n in NAMES if not duck.sql(f"SELECT count(*) FROM ({sql[n]})").fetchall()[0][0]] == []
