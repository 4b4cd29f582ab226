"""Small pictures: layout and bridges of at most a few dozen actors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20260914


def spring_layout(n: int, a: np.ndarray, b: np.ndarray, rounds: int = 200, seed: int = SEED) -> np.ndarray:
    """Fruchterman-Reingold positions in [0, 1]^2."""
    x = np.random.default_rng(seed).random((n, 2))
    k = 1 / np.sqrt(max(n, 1))
    for t in np.linspace(0.1, 0.001, rounds):
        d = x[:, None] - x[None]
        r = np.maximum(np.linalg.norm(d, axis=2), 1e-6)
        move = (d * (k * k / r**2)[:, :, None]).sum(axis=1)
        e = x[a] - x[b]
        pull = e * (np.linalg.norm(e, axis=1, keepdims=True) / k)
        np.add.at(move, a, -pull)
        np.add.at(move, b, pull)
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        x = x + move / size * np.minimum(size, t)
    low, high = x.min(axis=0), x.max(axis=0)
    return (x - low) / np.maximum(high - low, 1e-9)


def layout(links: DataFrame) -> DataFrame:
    """(actor_id, x, y) of the ends of some links (a, b), a bounded picture."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids, e = np.unique(np.concatenate([t["a"], t["b"]]), return_inverse=True)
        p = spring_layout(len(ids), e[: len(t)], e[len(t) :])
        return pd.DataFrame({"actor_id": ids, "x": p[:, 0], "y": p[:, 1]})

    return links.select("a", "b").orderBy("a", "b").groupBy().applyInPandas(run, "actor_id bigint, x double, y double")


def cut_vertices(n: int, a: list[int], b: list[int]) -> set[int]:
    """Nodes whose loss parts a connected part of the graph, by one depth-first pass without recursion."""
    near: list[list[int]] = [[] for _ in range(n)]
    for u, v in zip(a, b, strict=True):
        near[u].append(v)
        near[v].append(u)
    seen, low, out, clock = [-1] * n, [0] * n, set(), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack, branches = [(root, -1, iter(near[root]))], 0
        while stack:
            v, up, rest = stack[-1]
            for u in rest:
                if seen[u] < 0:
                    seen[u] = low[u] = clock
                    clock += 1
                    stack.append((u, v, iter(near[u])))
                    break
                if u != up:
                    low[v] = min(low[v], seen[u])
            else:
                stack.pop()
                if stack:
                    parent = stack[-1][0]
                    low[parent] = min(low[parent], low[v])
                    if parent == root:
                        branches += 1
                    elif low[v] >= seen[parent]:
                        out.add(parent)
        if branches > 1:
            out.add(root)
    return out


def bridges(links: DataFrame, partition: DataFrame, top: int = 3) -> DataFrame:
    """(actor_id, outside, outside_share, articulation): who ties communities, cut vertices first."""
    c = lambda k, n: partition.select(F.col("actor_id").alias(k), F.col("community_id").alias(n))
    both = links.join(c("a", "ca"), "a").join(c("b", "cb"), "b").select("a", "b", F.col("w").cast("double").alias("w"), (F.col("ca") != F.col("cb")).alias("out"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["a", "b"])
        ids, e = np.unique(np.concatenate([t["a"], t["b"]]), return_inverse=True)
        x, y, w = e[: len(t)], e[len(t) :], t["w"].to_numpy()
        o = w * t["out"].to_numpy()
        n = len(ids)
        outside, all_ = np.bincount(x, o, n) + np.bincount(y, o, n), np.bincount(x, w, n) + np.bincount(y, w, n)
        cut = cut_vertices(n, x.tolist(), y.tolist())
        return pd.DataFrame({"actor_id": ids, "outside": outside, "outside_share": outside / np.maximum(all_, 1e-12), "articulation": [i in cut for i in range(n)]})

    got = both.groupBy().applyInPandas(run, "actor_id bigint, outside double, outside_share double, articulation boolean")
    return got.where("outside > 0").orderBy(F.desc("articulation"), F.desc("outside"), "actor_id").limit(top)
