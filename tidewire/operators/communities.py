"""Communities by modularity: local moving, refinement and aggregation, in a fixed order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leiden(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seed: int = 20260914, rounds: int = 20) -> np.ndarray:
    """Community of each of n nodes of an undirected weighted graph, numbered by size (ties: least node).

    Nodes move, in a seeded order, to the neighbouring community of the largest gain until none
    gains; each community is then split where it is not connected (so that all are well connected),
    and the communities become the nodes of the next level.
    """
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    if not len(src):
        return label
    total = weight.sum() * 2
    s, d, w = np.r_[src, dst], np.r_[dst, src], np.r_[weight, weight].astype(float)
    node = np.arange(n)  # of the level's graph
    m = n
    for _ in range(rounds):
        order = np.argsort(s, kind="stable")
        s, d, w = s[order], d[order], w[order]
        start = np.searchsorted(s, np.arange(m + 1))
        deg = np.bincount(s, w, m)
        com, tot = np.arange(m), deg.copy()
        queue = list(rng.permutation(m))
        waiting = np.ones(m, bool)
        at = 0
        while at < len(queue):
            v = queue[at]
            at += 1
            waiting[v] = False
            nb, nw = d[start[v] : start[v + 1]], w[start[v] : start[v + 1]]
            other = nb != v
            nb, nw = nb[other], nw[other]
            if not len(nb):
                continue
            c = com[v]
            near, back = np.unique(com[nb], return_inverse=True)
            links = np.bincount(back, nw)
            tot[c] -= deg[v]
            gain = links - deg[v] * tot[near] / total
            here = gain[near == c][0] if (near == c).any() else -deg[v] * tot[c] / total
            k = int(np.argmax(gain))
            if gain[k] > here + 1e-12:
                com[v] = near[k]
                for u in nb[(com[nb] != near[k]) & ~waiting[nb]].tolist():
                    waiting[u] = True
                    queue.append(u)
            tot[com[v]] += deg[v]
        # split what is not connected within a community
        part = np.arange(m)
        inner = com[s] == com[d]
        while True:
            low = part.copy()
            np.minimum.at(low, s[inner], part[d[inner]])
            low = low[low]
            if (low == part).all():
                break
            part = low
        names, new = np.unique(part, return_inverse=True)
        if len(names) == m:
            break
        node = new[node]
        s, d = new[s], new[d]
        pair, back = np.unique(s * len(names) + d, return_inverse=True)
        w = np.bincount(back, w)
        s, d, m = pair // len(names), pair % len(names), len(names)
    sizes = np.bincount(node, minlength=m)
    first = np.full(m, n)
    np.minimum.at(first, node, np.arange(n))
    rank = np.empty(m, np.int64)
    rank[np.lexsort((first, -sizes))] = np.arange(m)
    return rank[node]


def detect(edges: DataFrame, seed: int = 20260914) -> DataFrame:
    """(window_start, actor_id, community_id) of each week's graph, directions summed; one task a week.

    Modularity is a property of the whole graph; a week's merged edges are what one task must hold.
    """

    def run(key, t):
        ids, e = np.unique(np.concatenate([t["src"], t["dst"]]), return_inverse=True)
        a, b = e[: len(t)], e[len(t) :]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pair, back = np.unique(lo * len(ids) + hi, return_inverse=True)
        com = leiden(len(ids), pair // len(ids), pair % len(ids), np.bincount(back, t["weight"]), seed)
        return pd.DataFrame({"window_start": key[0], "actor_id": ids, "community_id": com})

    return edges.select("window_start", "src", "dst", "weight").groupBy("window_start").applyInPandas(run, "window_start date, actor_id bigint, community_id bigint")


def louvain_terms(links: DataFrame) -> DataFrame:
    """(term, theme) of a term graph (a, b, weight); one task, bounded by the vocabulary of terms in two posts or more."""

    def run(t):
        ids, e = np.unique(np.concatenate([t["a"], t["b"]]).astype(str), return_inverse=True)
        com = leiden(len(ids), e[: len(t)], e[len(t) :], t["weight"].to_numpy(float))
        return pd.DataFrame({"term": ids.astype(object), "theme": com})

    return links.groupBy().applyInPandas(run, "term string, theme bigint")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(window_start, modularity) of a partition."""
    c = lambda a, b: partition.select("window_start", F.col("actor_id").alias(a), F.col("community_id").alias(b))
    e = edges.join(c("src", "cs"), ["window_start", "src"]).join(c("dst", "cd"), ["window_start", "dst"])
    inner = e.groupBy("window_start").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inner"))
    deg = e.select("window_start", "weight", F.explode(F.array("cs", "cd")).alias("c")).groupBy("window_start", "c").agg(F.sum("weight").alias("k"))
    sq = deg.groupBy("window_start").agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    return inner.join(sq, "window_start").select("window_start", (F.col("inner") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def betweenness(edges: DataFrame, most: int = 20_000, chunk: int = 64) -> DataFrame:
    """(window_start, actor_id, betweenness), directed, with 1/weight as length; weeks of over ``most`` actors are left out.

    Each source's shortest paths are independent: sources are dealt to tasks, which hold the week's
    edges and return partial sums.
    """
    import heapq

    size = edges.select("window_start", F.explode(F.array("src", "dst")).alias("v")).groupBy("window_start").agg(F.count_distinct("v").alias("n"))
    ok = edges.join(F.broadcast(size.where(F.col("n") <= most)), "window_start")
    deal = ok.select("window_start", "src", "dst", "weight", F.explode(F.sequence(F.lit(0), F.least(F.expr(f"n div {chunk}"), F.lit(63)).cast("int"))).alias("share"), F.least(F.expr(f"n div {chunk}"), F.lit(63)).alias("last"))

    def run(key, t):
        ids, e = np.unique(np.concatenate([t["src"], t["dst"]]), return_inverse=True)
        n, k = len(ids), int(t["last"].iloc[0]) + 1
        near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for a, b, w in zip(e[: len(t)].tolist(), e[len(t) :].tolist(), (1.0 / t["weight"]).tolist(), strict=True):
            near[a].append((b, w))
        out = np.zeros(n)
        for root in range(int(key[1]), n, k):
            dist, paths, before, order = {root: 0.0}, {root: 1.0}, {root: []}, []
            heap, done = [(0.0, root)], set()
            while heap:
                x, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for u, w in near[v]:
                    y = x + w
                    old = dist.get(u)
                    if old is None or y < old - 1e-12:
                        dist[u], paths[u], before[u] = y, paths[v], [v]
                        heapq.heappush(heap, (y, u))
                    elif abs(y - old) <= 1e-12 and u not in done:
                        paths[u] += paths[v]
                        before[u].append(v)
            part = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                for u in before[v]:
                    part[u] += paths[u] / paths[v] * (1 + part[v])
                if v != root:
                    out[v] += part[v]
        return pd.DataFrame({"window_start": key[0], "actor_id": ids, "b": out})

    parts = deal.groupBy("window_start", "share").applyInPandas(run, "window_start date, actor_id bigint, b double")
    return parts.groupBy("window_start", "actor_id").agg(F.sum("b").alias("betweenness"))
