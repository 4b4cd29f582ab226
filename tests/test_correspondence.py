"""Correspondence queries read the whole amplification table."""

import numpy as np

import __spark_entry__
from tidewire.operators import correspondence
from tidewire.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_correspondence_queries_use_every_cell(spark):
    queries = __spark_entry__.queries()
    whole = correspondence.prune(A.amplification(spark, SF))
    assert sorted(queries["M2_prune"](spark, SF).select("src", "dst").collect()) == sorted(whole.select("src", "dst").collect())
    table, coverage = correspondence.largest_component(whole)
    assert queries["M3_coverage"](spark, SF).collect() == coverage.collect()
    actors = {r[0] for r in table.select("src").union(table.select("dst")).distinct().collect()}
    got = {r["actor_id"] for r in queries["M4_M9_M12_positions"](spark, SF).collect()}
    assert actors and got == actors


def test_dealt_rows_give_the_scores_of_one_task_and_are_read_not_computed_again(spark):
    rng = np.random.default_rng(5)
    cells = sorted({(int(a), 1_000 + int(b)) for a, b in zip(rng.integers(0, 60, 500), rng.integers(0, 25, 500), strict=True)})
    df = spark.createDataFrame([(a, b, float(1 + (a * b) % 3)) for a, b in cells], "src long, dst long, weight double")
    one, many = correspondence.positions(df), correspondence.positions(df, task_cells=10)
    got = [{(r.side, r.actor_id, r.dim): r.score for r in x.collect()} for x in (one, many)]
    assert got[0].keys() == got[1].keys() and max(abs(got[0][k] - got[1][k]) for k in got[0]) < 1e-9
    assert all("FileScan" in x._jdf.queryExecution().toString() and "InPandas" not in x._jdf.queryExecution().toString() for x in (one, many))
