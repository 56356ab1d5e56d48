"""Every query of the map engine against its DuckDB twin, at the smallest scale."""

import os

import duckdb
import pytest

from atriumq import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _text(df, cols):
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


def test_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, con, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _text(got, cols) == _text(want, cols)


def test_twin_without_some_keys(spark, tmp_path, name="M08_navigation_rules"):
    c = duckdb.connect()
    for f in os.listdir(SF):
        wanted = "* REPLACE (CASE WHEN c_custkey % 20 = 7 THEN NULL ELSE c_custkey END AS c_custkey)" if f == "customer.parquet" else "*"
        if f.split(".")[0] in ("customer", "nation"):
            c.execute(f"COPY (SELECT {wanted} FROM '{SF}/{f}') TO '{tmp_path}/{f}' (FORMAT parquet)")
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tmp_path}/{f}'")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    assert len(got) and _text(got, cols := sorted(got.columns)) == _text(want, cols)


@pytest.mark.parametrize("name", ["G20_proposal", "G20_proposal_edges", "G20_proposal_places"])
def test_proposals_keep_all_walls_of_a_floor(spark, tmp_path, name):
    c = duckdb.connect()
    for t in ("nation", "customer", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    c.execute("CREATE VIEW supplier AS SELECT i AS s_suppkey, CAST(i % 2 AS INT) AS s_nationkey FROM range(1, 3001) r(i)")
    for t in ("nation", "customer", "part", "supplier"):
        c.execute(f"COPY (FROM {t}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    assert len(got) and _text(got, cols := sorted(got.columns)) == _text(want, cols)
    walls = registry.queries()["G20_proposal"](spark, str(tmp_path)).where("floor < 2").toPandas()["walls"]
    assert (walls > 4000).all() and "4000" not in registry.oracle_sql()[name]
