"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.compare import TABLES, norm

SF = "/root/testdata/sf0.001"
ENGINE = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ENGINE)
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    assert got and got == sorted(repr(tuple(norm(r[have.index(c)]) for c in cols)) for r in rel.fetchall())


def test_without_sql(spark):
    rows = entry.queries()["image_operators"](spark, SF).collect()
    assert len(rows) == 1720 and all(r["corners"] == 40 and r["tracked"] >= 30 and r["text"] == "CAM01" for r in rows if r["idx"] < 300)
    assert {r["text"] for r in rows if 745 <= r["idx"] < 795} != {"CAM01"}  # the text's anomaly is in it
    assert entry.entry(spark).count() > 0
