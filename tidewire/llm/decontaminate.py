"""Benchmark decontamination by suffix arrays over the training text.

The documents are cut into shards of about a megabyte. A shard's words become numbers of the
benchmark's vocabulary (0 for any other word, which no test suffix can pass), its suffix array is
sorted as deep as the longest test item, and every test suffix is searched in it by bisection: the
interval of suffixes that begin with the suffix's first ``window`` words gives all places, and runs
of places on one diagonal give the longest verbatim matches. Suffixes whose first two words no test
item has in that order stay out of the array; no test suffix could meet them.

The test items travel as broadcast blocks of a bounded size; documents pass the blocks one after
another, in the same task, so the benchmark may have any size and nothing is joined.

Defined cases: null texts have no words; items with a null id or no words are skipped; rows of one
item_id count as one item; repeated documents are judged each by itself; an empty benchmark hits
nothing; an input column with the name of a computed one is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ALNUM, LOWER, U64, blocks, fresh, prefix_hash, span_hash, trimmed, word_spans

OUT = ("n_words", "n_hit", "n_items", "items", "spans", "matches")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("len", pa.int64())]))
FIELDS = "n_words bigint, spans array<struct<start: bigint, len: bigint>>, matches array<struct<item_id: string, item_start: bigint, doc_start: bigint, len: bigint>>"


def _hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    s, e, row = word_spans(low, offs, ALNUM)
    return span_hash(prefix_hash(low), s, e), row


class TestSuffixes:
    """The suffixes of some test items, with their vocabulary."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int):
        raw = [t.encode() for t in texts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)], dtype=np.int64)
        h, row = _hashes(data, offs)
        self.vocab = np.unique(h)
        self.bits = max(1, int(len(self.vocab) + 1).bit_length())
        word = np.searchsorted(self.vocab, h).astype(np.int32) + 1
        length = np.bincount(row, minlength=len(ids)) if len(ids) else np.zeros(0, int)
        first = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        self.depth = int(length.max(initial=1))
        self.items = ids
        padded = np.concatenate([word, np.zeros(self.depth, np.int32)])
        at, item = [], []
        for k, n in enumerate(length):
            take = n if n < window else n - window + 1
            if n:
                at.append(first[k] + (np.arange(take) if n >= window else np.zeros(1, np.int64)))
                item.append(np.full(take if n >= window else 1, k))
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.item = np.concatenate(item).astype(np.int64) if item else np.zeros(0, np.int64)
        self.offset = self.at - first[self.item]
        self.size = np.minimum(length[self.item], window).astype(np.int64) if len(self.at) else np.zeros(0, np.int64)
        width = int(self.size.max(initial=1))
        self.rows = padded[self.at[:, None] + np.arange(width)]
        self.rows[np.arange(width) >= self.size[:, None]] = -1
        n = len(self.vocab) + 1
        self.single = np.zeros(n, bool)
        self.single[self.rows[self.size == 1, 0]] = True
        two = self.rows[self.size > 1]
        self.pairs = np.unique(two[:, 0].astype(np.int64) * n + two[:, 1]) if len(two) else np.zeros(0, np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.vocab & U64((1 << 20) - 1)] = True
        self.starts = np.zeros(n, bool)
        self.starts[self.rows[:, 0]] = True


def _sorted_suffixes(tok: np.ndarray, at: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes of ``tok``, to ``depth`` words or the first 0."""
    per = 63 // bits

    def keys(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, live = np.zeros(len(p), np.int64), np.ones(len(p), bool)
        for j in range(per):
            x = tok[np.minimum(p + j, len(tok) - 1)].astype(np.int64)
            live &= x > 0
            k = (k << bits) | np.where(live, x, 0)
        return k, live

    k, live = keys(at)
    order = np.argsort(k, kind="stable")
    at, k, live = at[order], k[order], live[order]
    new = np.ones(len(at), bool)
    new[1:] = k[1:] != k[:-1]
    done = per
    while done < depth:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero((np.bincount(group)[group] > 1) & live) if len(at) else np.zeros(0, int)
        if not len(tied):
            break
        k, more = keys(at[tied] + done)
        order = np.lexsort((k, group[tied]))
        k, g = k[order], group[tied][order]
        at[tied] = at[tied][order]
        live[tied] = more[order]
        fresh_ = np.ones(len(tied), bool)
        fresh_[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        new[tied] |= fresh_
        done += per
    return at


def _interval(tok: np.ndarray, sa: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the bounds in ``sa`` of the suffixes that begin with its first ``size`` words."""

    def side(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for j in range(rows.shape[1]):
                x, y = tok[np.minimum(sa[mid] + j, len(tok) - 1)], rows[open_, j]
                inside = equal & (j < size[open_])
                less |= inside & (x < y)
                equal &= ~inside | (x == y)
            right = less | equal if upper else less
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    return side(False), side(True)


def _shard(tests: TestSuffixes, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Words of each document; its hit runs of words; its longest verbatim matches."""
    n = len(offs) - 1
    h, row = _hashes(data, offs)
    count = np.bincount(row, minlength=n)
    spans, matches = [[] for _ in range(n)], [[] for _ in range(n)]
    if not len(h) or not len(tests.at):
        return count, spans, matches
    tok = np.zeros(len(h) + n + 1, np.int32)  # a 0 ends each document
    may = np.flatnonzero(tests.sieve[h & U64((1 << 20) - 1)])
    k = np.minimum(np.searchsorted(tests.vocab, h[may]), len(tests.vocab) - 1)
    tok[may + row[may]] = np.where(tests.vocab[k] == h[may], k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) + np.arange(n)
    at = np.flatnonzero(tests.starts[tok])
    pair = tok[at].astype(np.int64) * (len(tests.vocab) + 1) + tok[np.minimum(at + 1, len(tok) - 1)]
    if len(tests.pairs):
        j = np.minimum(np.searchsorted(tests.pairs, pair), len(tests.pairs) - 1)
        at = at[(tests.pairs[j] == pair) | tests.single[tok[at]]]
    else:
        at = at[tests.single[tok[at]]]
    sa = _sorted_suffixes(tok, at, tests.bits, tests.depth)
    lo, hi = _interval(tok, sa, tests.rows, tests.size)
    hits = hi - lo
    if not hits.sum():
        return count, spans, matches
    q = np.repeat(np.arange(len(hits)), hits)
    pos = sa[np.repeat(lo, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
    item, start, size = tests.item[q], tests.offset[q], tests.size[q]
    order = np.lexsort((pos, pos - start, item))
    item, start, size, pos = item[order], start[order], size[order], pos[order]
    cut = np.ones(len(pos), bool)
    cut[1:] = (item[1:] != item[:-1]) | (pos[1:] - start[1:] != pos[:-1] - start[:-1]) | (pos[1:] != pos[:-1] + 1)
    b = np.flatnonzero(cut)
    e = np.append(b[1:], len(pos)) - 1
    doc = np.searchsorted(first, pos[b], "right") - 1
    for d, i, s, p, m in zip(doc.tolist(), item[b].tolist(), start[b].tolist(), (pos[b] - first[doc]).tolist(), (pos[e] - pos[b] + size[e]).tolist(), strict=True):
        matches[d].append({"item_id": tests.items[i], "item_start": s, "doc_start": p, "len": m})
    for d in np.unique(doc).tolist():
        spans[d] = _union([(x["doc_start"], x["len"]) for x in matches[d]])
    return count, spans, matches


def _union(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, n in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [{"start": s, "len": e - s} for s, e in out]


def _test_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Test items in blocks of about ``block_bytes``; the driver holds one at a time."""
    ids, texts, held = [], [], 0
    for i, t in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if texts and held + len(t) > block_bytes:
            yield TestSuffixes(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(i)
        texts.append(t)
        held += len(t)
    yield TestSuffixes(ids, texts, window)


def search(docs: DataFrame, benchmark: DataFrame, window: int = 8, shard_bytes: int = 1 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit (words in hit windows), items (sorted ids), n_items, spans and matches.

    ``spans`` are merged runs of hit words; ``matches`` have each longest verbatim match of
    ``window`` words or more (or a whole shorter item) with its places in item and document.
    """
    docs = fresh(docs, *OUT)
    sc = docs.sparkSession.sparkContext
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<start: bigint, len: bigint>>)"), "matches": F.expr("cast(array() as array<struct<item_id: string, item_start: bigint, doc_start: bigint, len: bigint>>)")})
    for tests in _test_blocks(benchmark, window, block_bytes):
        held = sc.broadcast(tests)

        def find(batches, held=held):
            for batch, data, offs in blocks(batches, "text", shard_bytes):
                count, spans, matches = _shard(held.value, data, offs)
                old_s, old_m = batch.column("spans").to_pylist(), batch.column("matches").to_pylist()
                spans = [_union([(x["start"], x["len"]) for x in a + b]) if a else b for a, b in zip(old_s, spans, strict=True)]
                cols = batch.columns[:-3] + [pa.array(count, pa.int64()), pa.array(spans, _SPAN), pa.array([a + b for a, b in zip(old_m, matches, strict=True)], _MATCH)]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        out = out.mapInArrow(trimmed(find), f"{schema}, {FIELDS}")
    zero = F.lit(0).cast("long")
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))))
    return out.withColumns({"n_hit": F.aggregate("spans", zero, lambda a, x: a + x["len"]), "n_items": F.size("items").cast("long")})


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, least_words: int = 8) -> DataFrame:
    """``docs`` without those that hold windows of ``least_items`` test items, or ``least_words`` words of one.

    An item shorter than ``least_words`` doesn't count alone: a few words meet by chance.
    """
    found = search(docs, benchmark, window)
    whole = F.exists("matches", lambda m: m["len"] >= least_words)
    return found.where(~((F.col("n_items") >= least_items) | whole)).select(*[c for c in docs.columns if c in found.columns])
