"""Every named query against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import registry

SF = Path("/root/testdata/sf0.001")


def rows(df, columns):
    def plain(v):
        return round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    df = df[columns].astype(object)
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_native(spark):
    if not SF.exists():
        pytest.skip("no driver tables")
    for name in ("path_full_chain_deep", "secrets_dedup", "scan_results"):
        plan = registry.QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
