import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

SMALL = ["G04_numeric_moments", "G08_quantiles_mad_outliers", "A04_association_table", "L03_stratified_split",
         "R09_prepare_task", "D02_density", "V02_classification_metrics"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_query_has_unique_id():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)


@pytest.mark.parametrize("name", SMALL)
def test_oracle_parity_small(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, cur.fetchall())
