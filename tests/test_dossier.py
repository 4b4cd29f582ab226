"""The dossier's parts on small rows."""

from tidewire.operators import correspondence, dossier


def test_cards_without_places_or_terms(spark):
    c = spark.createDataFrame([(0, 2), (1, 1)], "community_id int, size int")
    p = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "actor_id int, community_id int")
    at = spark.createDataFrame([(1, 1, 0.5), (2, 1, -0.1), (1, 2, 1.0)], "actor_id int, dim int, score double")
    t = spark.createDataFrame([(0, "b", 2.0), (0, "a", 3.0)], "community_id int, term string, lift double")
    got = {r["community_id"]: r.asDict() for r in dossier.community_cards(c, p, at, t).collect()}
    assert got[0] == {"community_id": 0, "size": 2, "axis": 0.2, "n_axis": 2, "axis2": 1.0, "terms": ["a", "b"]}
    assert got[1] == {"community_id": 1, "size": 1, "axis": None, "n_axis": 0, "axis2": None, "terms": []}


def test_map_of_two_groups(spark):
    rows = [("w", s, d, 1.0) for g in range(2) for s in range(10 * g + 100, 10 * g + 104) for d in (10 * g + 1, 10 * g + 2, 10 * g + 3)] + [("w", 100, 50, 1.0), ("w", 1, 2, 2.0)]
    e = spark.createDataFrame(rows, "window_start string, src bigint, dst bigint, weight double")
    rank = e.groupBy("dst").sum("weight").toDF("actor_id", "value")
    m = dossier.network_map(e, rank, top=7)
    s = m["summary"].collect()[0]
    assert (s["actors"], s["links_all"], s["loose"], s["direct_edges"], s["direct_weight"]) == (7, 6, 1, 1, 2.0)
    nodes = {r["actor_id"]: r for r in m["nodes"].collect()}
    assert nodes[50]["x"] is None and nodes[50]["audience"] == 1 and nodes[2]["audience"] == 5 and nodes[1]["x"] is not None
    none = dossier.network_map(e.limit(0), rank.limit(0))
    assert none["nodes"].count() == 0 and none["summary"].collect()[0]["mean_degree"] == 0


def test_degenerate_dimension(spark):
    two = spark.createDataFrame([(i, 1, 1.0 if i % 2 else -1.0) for i in range(20)], "actor_id int, dim int, score double")
    p = spark.createDataFrame([(i, i % 2) for i in range(20)], "actor_id int, community_id int")
    assert correspondence.chosen_dimension(correspondence.agreement(two, p), two).collect()[0]["dim"] == 2
    assert correspondence.chosen_dimension(correspondence.agreement(two.limit(0), p), two.limit(0)).count() == 0


def test_commands(spark, tmp_path, capsys):
    import datetime
    import json

    from tidewire import cli

    day = datetime.datetime(2024, 1, 9)
    rows = [(n, s, d, "repost", day + datetime.timedelta(seconds=n), "T") for n, (s, d) in enumerate((s, d) for s in range(20, 30) for d in (1, 2, 3))]
    spark.createDataFrame(rows, "post_id bigint, src bigint, dst bigint, kind string, occurred_at timestamp, label string").write.parquet(f"{tmp_path}/interaction")
    spark.createDataFrame([(i, f"u{i}", "A" if i < 4 else "C") for i in (1, 2, 3, *range(20, 30))], "actor_id bigint, handle string, tier string").write.parquet(f"{tmp_path}/actor")
    args = lambda c, *more: cli.parser().parse_args([c, "--data", str(tmp_path), *more])
    cli.cmd_status(spark, args("status"))
    out = capsys.readouterr().out
    assert "repost" in out and "tier" in out
    cli.cmd_dossier(spark, args("dossier", "--out", f"{tmp_path}/d.json"))
    d = json.load(open(f"{tmp_path}/d.json", encoding="utf-8"))
    assert d["summary"][0]["actors"] == 13, d["summary"]
    assert len(d["links"]) == 3 and d["map"][0]["direct_edges"] == 30
    assert {n["handle"] for n in d["nodes"] if n.get("x") is not None} == {"u1", "u2", "u3"} and d["axis"] == []
