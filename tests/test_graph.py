import datetime
import random

import numpy as np
import pytest

from tidewire.functions.scope import Scope, labels_of, split_partition, split_window, topic_scope
from tidewire.operators import communities, correspondence, edges, graph, maps

W = datetime.date(2026, 9, 14)


def frame(spark, rows):
    return spark.createDataFrame([(W, *r) for r in rows], "window_start date, src bigint, dst bigint, weight double")


def test_scopes():
    for s in ("amp", "amp:topic:a+b:core", "reply:core", "amp@2023-01-16:amp:core", "reply@amp"):
        assert str(Scope.parse(s)) == s
    assert topic_scope(["b", "a", "b"]) == "topic:a+b" and topic_scope([]) == "all" and labels_of("amp:topic:x:core") == ["x"]
    assert split_window("2023-01-16:amp:core") == ("2023-01-16", "amp:core") and split_partition("amp") == (None, "amp")
    for bad in (lambda: topic_scope(["a+b"]), lambda: split_partition("2023-01-16"), lambda: split_window("amp"), lambda: Scope("nope")):
        with pytest.raises(ValueError):
            bad()


def planted(sizes, inner, outer, seed=1):
    rng = np.random.default_rng(seed)
    com = np.repeat(np.arange(len(sizes)), sizes)
    same = com[:, None] == com[None]
    hit = np.triu(rng.random(same.shape) < np.where(same, inner, outer), 1)
    return com, np.argwhere(hit)


def test_leiden_recovers_planted_blocks():
    com, e = planted([40, 30, 20, 10], 0.6, 0.01)
    got = communities.leiden(len(com), e[:, 0], e[:, 1], np.ones(len(e)))
    assert (got == com).all()
    assert (communities.leiden(len(com), e[:, 0], e[:, 1], np.ones(len(e))) == got).all()
    assert communities.leiden(3, e[:0, 0], e[:0, 1], np.ones(0)).tolist() == [0, 1, 2]


def test_pagerank_both_ways(spark):
    rng = random.Random(2)
    rows = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    rows = [(a, b, 1.0 + (a + b) % 3) for a, b in rows if a != b] + [(0, 99, 1.0)]
    df = frame(spark, rows)
    x = {r["actor_id"]: r["pagerank"] for r in graph.pagerank(df).collect()}
    y = {r["actor_id"]: r["pagerank"] for r in graph.pagerank(df, rounds=12, tolerance=1e-3, task_edges=0).collect()}
    assert sum(x.values()) == pytest.approx(1) and sum(y.values()) == pytest.approx(1) and x == pytest.approx(y, abs=5e-3)


def test_betweenness_of_a_path(spark):
    b = {r["actor_id"]: r["betweenness"] for r in communities.betweenness(frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 0.1)]), chunk=2).collect()}
    assert b == {0: 0, 1: 2, 2: 2, 3: 0}


def test_core_and_components(spark):
    rows = [(0, 1, 2.0), (1, 2, 2.0), (2, 0, 2.0), (3, 0, 0.5), (4, 3, 1.0), (7, 8, 5.0)]
    kept = {(r["src"], r["dst"]) for r in graph.core(frame(spark, rows)).collect()}
    assert kept == {(0, 1), (1, 2), (2, 0), (7, 8)}
    got = {r["actor_id"]: r["component"] for r in graph.components(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 7: 7, 8: 7}


def test_concentration_alert(spark):
    r = edges.concentration(frame(spark, [(i, 500 + i, 1.0) for i in range(200)] + [(999, 1, 400.0)])).first()
    assert r["alert"] and r["top1_share"] == pytest.approx(400 / 600)


def test_correspondence_closed_form():
    rows = [(a, c, w) for a in range(8) for c, w in ((0, 3.0), (1, 2.0))] + [(a, c, w) for a in range(8, 16) for c, w in ((2, 3.0), (3, 2.0))] + [(16, 0, 2.0), (16, 2, 2.0)]
    i, j, w = (np.array(x) for x in zip(*rows))
    r, c, d = correspondence.dimensions(i, j, w.astype(float))
    assert d[0]["converged"] and abs(r[0][16]) < 1e-6 and (np.sign(r[0][:8]) == -np.sign(r[0][8:16])).all()
    t = np.zeros((17, 4))
    t[i, j] = w
    e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
    assert d[0]["total_inertia"] == pytest.approx(((t - e) ** 2 / e).sum() / t.sum(), abs=1e-9)
    flat = correspondence.dimensions(*(np.array(x) for x in zip(*[(a, b, 1.0) for a in range(8) for b in range(3)])))
    assert abs(flat[2][0]["total_inertia"]) < 1e-6


def test_cut_vertices_and_layout():
    assert maps.cut_vertices(5, [0, 1, 2, 2, 3], [1, 2, 0, 3, 4]) == {2, 3}
    x = maps.spring_layout(5, np.array([0, 1, 2]), np.array([1, 2, 0]))
    assert x.min() >= 0 and x.max() <= 1 and (x == maps.spring_layout(5, np.array([0, 1, 2]), np.array([1, 2, 0]))).all()


def test_disparity_keeps_lone_ends_and_is_monotone(spark):
    links = spark.createDataFrame([(0, k, 1.0 + 50 * (k == 1)) for k in range(1, 9)] + [(1, 2, 1.0), (3, 4, 1.0)], "a bigint, b bigint, w double")
    al = {(r["a"], r["b"]): r["alpha"] for r in graph.disparity(links).collect()}
    assert al[0, 8] == 0 and al[0, 1] < 0.2
    assert graph.skeleton(graph.disparity(links)).where("chosen").count() == 1
