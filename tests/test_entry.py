import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", [
    "dup_decisions", "stay_points_centroid", "classify_v1", "crosstab_margins", "psi", "plt_scan", "stay_evaluation", "jump_overview",
    "shared_pairs", "window_grid", "observed_vs_duration", "bootstrap_ci", "stay_invariants", "city_zones", "job_states",
])
def test_same_rows_as_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})")
    key = lambda row: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(key(r) for r in got.select(*columns).collect()) == sorted(key(r) for r in cursor.fetchall())
