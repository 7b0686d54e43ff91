"""Named queries against their SQL twins on the smallest test tables, where those are present."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ("f01_canonical_names", "f24_decayed_strength", "g03_spread_activation", "g07_budget_select", "g08_memory_lines", "w10_er_resolution", "m07_upserted_edges", "m08_superseded_edges", "j06_nearest_vectors", "y14_retrieve_memory", "p4_found")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def table(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and table(got) == table(want)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
