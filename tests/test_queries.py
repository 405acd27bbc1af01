import pandas as pd
import pytest

from gristmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        return
    con = duckdb.connect()
    from gristmill.sources.sql_surface import TABLES

    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        def cell(v):
            if v is None or v is pd.NA or v != v:
                return ""
            return f"{float(v):.6f}" if pd.api.types.is_number(v) and not pd.api.types.is_bool(v) else str(v)

        return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))

    assert rows(got) == rows(want)
