"""Quality by votes of the nearest labelled documents in a latent space.

A text is its byte trigrams (hashed into a fixed number of slots, case and marks kept), with
logarithmic counts weighted by inverse document frequency, and the deciles of the shares of its
lines and of its 3-word windows that are repeats, and its length, as further terms. A singular value decomposition of a
bounded sample of labelled texts gives the latent space. The sample's vectors and labels are
broadcast; every document's cosines with all of them are computed in blocks, exactly, and the
nearest ``neighbours`` vote with their similarity.

Defined cases: an empty (or null) text, or one without a trigram, has no direction and scores the
share of label 1 in the sample; so do all texts when there are no labels (0.5); labels of a
document that are given more than once are averaged; repeated rows are alike; an input column named
like a computed one is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACED, U64, blocks, fresh, mix, prefix_hash, span_hash, word_spans

SLOTS = 1 << 12
SHAPES = 40
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def trigram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams of each row."""
    n = len(offs) - 1
    if len(data) < 3:
        return np.zeros((n, SLOTS), np.float32)
    d = data.astype(np.uint32)
    slot = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    row = np.repeat(np.arange(n), np.diff(offs))
    same = row[:-2] == row[2:]
    return np.bincount((row[:-2] * SLOTS + slot)[same], minlength=n * SLOTS).reshape(n, SLOTS).astype(np.float32)


def shape_terms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One-hot deciles of repeated lines and repeated 3-word windows, and of the logarithm of the words."""
    n = len(offs) - 1
    out = np.zeros((n, SHAPES), np.float32)
    prefix = prefix_hash(data)
    s, e, row = word_spans(data, offs, SPACED)
    h = span_hash(prefix, s, e)
    with np.errstate(over="ignore"):
        windows = mix(h[:-2] * U64(3) + h[1:-1] * U64(0x9FB21C651E98DF25)) + h[2:] if len(h) > 2 else h[:0]
    same = row[:-2] == row[2:] if len(h) > 2 else np.zeros(0, bool)
    ls, le, lrow = word_spans(data, offs, _NOT_NEWLINE)
    for k, (of, keys) in enumerate(((row[:-2][same], windows[same]), (lrow, span_hash(prefix, ls, le)))):
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        again = np.r_[False, (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])] if len(of) else np.zeros(0, bool)
        total = np.bincount(of, minlength=n)
        share = np.bincount(of, again, n) / np.maximum(total, 1)
        out[np.arange(n), 11 * k + (share * 10).astype(int)] = total > 0
    words = np.bincount(row, minlength=n)
    out[np.arange(n), 22 + np.minimum(np.log2(words + 1).astype(int), SHAPES - 23)] = 1
    return out


def terms(data: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted trigrams, followed by the shape terms at half their weight; zero where there is no trigram."""
    x = _unit(np.log1p(trigram_counts(data, offs)) * idf)
    return np.concatenate([x, 0.5 * shape_terms(data, offs) * (x.any(axis=1)[:, None])], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", row_id: str = "doc_id", sample: int = 4000, dims: int = 64) -> dict:
    """{idf, space, vectors, labels} of at most ``sample`` labelled documents, drawn by a hash of the id."""
    given = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("__tw_id")).agg(F.avg(F.col(label).cast("double")).alias("__tw_y"))
    drawn = given.orderBy(F.xxhash64(F.lit(7), F.col("__tw_id").cast("string")), "__tw_id").limit(sample)
    texts = docs.select(F.col(row_id).alias("__tw_d"), F.col(text).alias("__tw_t")).join(F.broadcast(drawn), F.col("__tw_d") == F.col("__tw_id"))

    def count(batches):
        for b, data, offs in blocks(batches, "__tw_t", 1 << 20):
            x = np.concatenate([trigram_counts(data, offs), shape_terms(data, offs)], axis=1).astype(np.uint32)
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays([b.column("__tw_d").cast(pa.string()), b.column("__tw_y"), pa.array(at, pa.list_(pa.int32())), pa.array([r[k].astype(np.int32) for r, k in zip(x, at, strict=True)], pa.list_(pa.int32()))], names=["id", "y", "at", "n"])

    got = texts.mapInArrow(count, "id string, y double, at array<int>, n array<int>").limit(sample).toArrow().sort_by("id")
    x, y = np.zeros((got.num_rows, SLOTS + SHAPES), np.float32), got.column("y").to_numpy()
    for i, (at, n) in enumerate(zip(got.column("at"), got.column("n"), strict=True)):
        x[i, at.values.to_numpy()] = n.values.to_numpy()
    if not len(x):
        return {"prior": 0.5}
    grams, shapes = x[:, :SLOTS], x[:, SLOTS:]
    idf = np.log((1 + len(x)) / (1 + (grams > 0).sum(axis=0))).astype(np.float32) + 1
    grams = _unit(np.log1p(grams) * idf)
    x = np.concatenate([grams, 0.5 * shapes * grams.any(axis=1)[:, None]], axis=1)
    k = min(dims, *x.shape)
    q = np.random.default_rng(11).standard_normal((SLOTS + SHAPES, min(k + 16, SLOTS))).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    space = (q @ v[:k].T).astype(np.float32)
    return {"idf": idf, "space": space, "vectors": _unit(x @ space), "labels": y, "prior": float(y.mean())}


def vote(model: dict, data: np.ndarray, offs: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    n = len(offs) - 1
    if "space" not in model:
        return np.full(n, model["prior"])
    z = _unit(terms(data, offs, model["idf"]) @ model["space"])
    sims = z @ model["vectors"].T
    k = min(neighbours, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (n, 1))
    w = np.maximum(np.take_along_axis(sims, top, axis=1), 0).astype(np.float64) ** power
    total = w.sum(axis=1)
    return np.where(total > 0, (w * model["labels"][top]).sum(axis=1) / np.maximum(total, 1e-12), model["prior"]).clip(0, 1)


def score(docs: DataFrame, model: dict, text: str = "text", neighbours: int = 15, power: float = 8.0) -> DataFrame:
    """``docs`` with ``score``, the weighted share of label 1 among the nearest labelled documents."""
    docs = fresh(docs, "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # sample x dims and SLOTS x dims floats
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches):
        for batch, data, offs in blocks(batches, text, 1 << 20):
            parts = [vote(held.value, data[offs[i] : offs[min(i + 256, batch.num_rows)]], offs[i : i + 257] - offs[i], neighbours, power) for i in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts), pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(work, f"{schema}, score double")
