"""Registered queries against their DuckDB twins on the smallest tables, where they are there."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["entry_weekly_top_receivers", "E2_view_edges_amp", "E7_topic_spread", "K5_ei_index", "K14_disparity", "L1_seed_candidates", "I9_terms", "M11_inertia", "G3_topic_actors", "O6_community_cards", "K17_map_summary", "K17_map_nodes", "M10_dimension", "O12_status", "O12_status_cut", "O10_label_volume"]


def rows(df):
    show = lambda v: "-" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)[:10]
    df = df[sorted(df.columns)]
    return sorted(tuple(show(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_twin_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90
