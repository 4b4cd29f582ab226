"""A bigram language model in a log-frequency Bloom filter (Talbot and Osborne 2007).

Words are counted exactly over all training documents, pairs of words likewise; every pair that occurs
``least`` times (once) or more enters the filter with its quantised count: q = 1 + floor(log_base(c /
least)), stored as the q keys (pair, 1) .. (pair, q). A lookup probes levels until one is missing,
which gives the least count of that level; a false positive makes it one level too high at
most, with the filter's small error rate. Each bucket of pairs has its own stretch of the filter, made where
the bucket was counted. Tasks write the filter and the exact word counts to files of the shared folder, each
for a range of buckets, and workers map these into memory; the driver knows their names and where a bucket starts.

Score: log10 of lambda * c(h, w) / c(h) + (1 - lambda) * (c(w) + 1) / (N + V + 1), where lambda
depends on the magnitude of c(h) and is the best of a grid for left-out occurrences in all training
documents. The history of a document's first word is the end
token.

Defined cases: a null text is empty, one end token; a null id is never held out; without training
documents all counts are zero; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import buckets_for, merged, pack, pack_keys, pieces, unpack, unpack_keys
from ._shared import LOWER, SPACED, U64, blocks, fresh, mix, prefix_hash, scratch, span_hash, staged, word_spans

END = U64(0x5851F42D4C957F2D)
CLASSES = 24
GRID = np.linspace(0.0, 0.95, 20)
HASHES = 4
M32 = U64(0xFFFFFFFF)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (words, then one end a document), hash of its pair, and the first token of each document."""
    low = LOWER[data]
    s, e, row = word_spans(low, offs, SPACED)
    n = len(offs) - 1
    tok = np.full(len(s) + n, END, np.uint64)
    tok[np.arange(len(s)) + row] = span_hash(prefix_hash(low), s, e)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)])[:-1]
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[first] = END  # the token before a document is an end in any case
    with np.errstate(over="ignore"):
        pair = mix(prev * U64(0x9FB21C651E98DF25) + tok)
    return tok, pair, first


def levels(counts: np.ndarray, least: int, base: float) -> np.ndarray:
    """Quantised counts, from 1 at ``least``."""
    return 1 + np.floor(np.log(np.maximum(counts, least) / least) / math.log(base) + 1e-9).astype(np.int64)


def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (key, level), of which the filter's are made."""
    with np.errstate(over="ignore"):
        h = mix(keys + U64(level) * U64(0xA24BAED4963EE407))
    return h & M32, (h >> U64(32)) | U64(1)


def _bit(a: np.ndarray, b: np.ndarray, j: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The ``j``-th bit within a stretch of ``size``, 2^32 at most."""
    return (((a + b * U64(j)) & M32) * size >> U64(32)).astype(np.int64)


class Model:
    """Exact word counts and the filter, for lookups.

    ``words`` are (words, counts) by ranges of words, ``filters`` (first bucket, bits) by ranges of buckets, both
    ascending; bucket k has ``size[k]`` bits from ``start[k]`` on in its range.
    """

    def __init__(self, words: list, filters: list, start: np.ndarray, size: np.ndarray, total: int, least: int, base: float, key_bits: int, lambdas: np.ndarray | None = None):
        self.words, self.filters, self.start, self.size = words, filters, start, size
        self.least, self.base, self.key_bits, self.lambdas = least, base, key_bits, lambdas
        self.n, self.v = total, sum(len(w) for w, _ in words)

    def word_counts(self, tok: np.ndarray) -> np.ndarray:
        u, back = np.unique(tok, return_inverse=True)
        out = np.zeros(len(u), np.int64)
        cut = [*np.searchsorted(u, np.array([w[0] for w, _ in self.words], np.uint64)), len(u)]
        for (words, counts), x, y in zip(self.words, cut[:-1], cut[1:], strict=True):
            k = np.minimum(np.searchsorted(words, u[x:y]), len(words) - 1)
            out[x:y] = np.where(words[k] == u[x:y], counts[k], 0)
        return out[back]

    def pair_counts(self, pair: np.ndarray) -> np.ndarray:
        """The least count of the level of each, 0 below ``least``."""
        pair, back = np.unique(pair, return_inverse=True)
        key = pair >> U64(64 - self.key_bits)
        buckets = len(self.size)
        bucket = (key >> U64(self.key_bits - buckets.bit_length() + 1)).astype(np.int64)
        size, start = self.size[bucket].astype(np.uint64), self.start[bucket]
        q = np.zeros(len(pair), np.int64)
        cut = [*np.searchsorted(bucket, [k for k, _ in self.filters]), len(bucket)]
        for (_, data), x, y in zip(self.filters, cut[:-1], cut[1:], strict=True):
            level, live = 0, x + np.flatnonzero(size[x:y] > 0)
            while live.size:
                level += 1
                a, b = _hashes(key[live], level)
                for j in range(HASHES):
                    at = _bit(a, b, j, size[live]) + start[live]
                    hit = np.flatnonzero(data[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    if len(hit) < len(live):
                        live, a, b = live[hit], a[hit], b[hit]
                q[live] = level
        q = q[back]
        return np.where(q > 0, np.ceil(self.least * self.base ** (q - 1.0) - 1e-9), 0).astype(np.int64)

    def kind(self, c_hist: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(np.maximum(c_hist, 1)).astype(np.int64), CLASSES - 1)

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of each document."""
        tok, pair, first = _tokens(data, offs)
        c, c2 = self.word_counts(tok), self.pair_counts(pair)
        end = self.word_counts(np.array([END]))[0]
        hist = np.empty_like(c)
        hist[1:] = c[:-1]
        hist[first] = end
        p1 = (c + 1) / (self.n + self.v + 1)
        lam = self.lambdas[self.kind(hist)]
        p = np.where(hist > 0, lam * np.minimum(c2, hist) / np.maximum(hist, 1) + (1 - lam) * p1, p1)
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return np.diff(np.append(first, len(tok))), total((c > 0).astype(np.int64)), total(np.log10(p1)), total(np.log10(p))

    def left_out(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Log likelihood by history class and grid value, each token's own occurrence left out."""
        tok, pair, first = _tokens(data, offs)
        c, c2 = np.maximum(self.word_counts(tok) - 1, 0), self.pair_counts(pair)
        hist = np.empty_like(c)
        full = self.word_counts(tok)
        hist[1:] = full[:-1]
        hist[first] = self.word_counts(np.array([END]))[0]
        kind, h = self.kind(hist), np.maximum(hist - 1, 1)
        c2 = np.where(c2 > self.least, c2 - 1, 0)
        p1, p2 = (c + 1) / (self.n + self.v), np.minimum(c2 / h, 1.0)
        # a pair without counts adds log10(1 - g) + log10(p1): only the others need each g
        no, yes = p2 == 0, np.flatnonzero(p2 > 0)
        n0, s0 = np.bincount(kind[no], minlength=CLASSES), np.bincount(kind[no], np.log10(p1[no]), CLASSES)
        # products of 16 or fewer ratios of a class, 10^-21 to 10^240, take one logarithm
        yes = yes[np.argsort(kind[yes].astype(np.uint8), kind="stable")]
        kind, s1 = kind[yes], np.bincount(kind[yes], np.log10(p1[yes]), CLASSES)
        ratio = np.minimum(p2[yes] / p1[yes], 1e15)
        cut = np.flatnonzero((np.arange(len(yes)) % 16 == 0) | np.diff(kind, prepend=-1).astype(bool))
        at = kind[cut]
        total = lambda g: np.bincount(at, np.log10(np.multiply.reduceat(1 - g + g * ratio, cut)), CLASSES) if len(cut) else np.zeros(CLASSES)
        return np.stack([n0 * np.log10(1 - g) + s0 + s1 + total(g) for g in GRID], axis=1)


def _save(rows: DataFrame, reads: dict, path: str, parts: int) -> list[tuple[int, str]]:
    """(first bucket, name) of each range of buckets, ascending: the columns ``reads`` of its rows, as read, end to end in files of their own.

    The tasks that hold the rows write the files; the driver is sent the names.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        fs, p = pafs.FileSystem.from_uri(path)
        fs.create_dir(p, recursive=True)
        name, first, size = uuid.uuid4().hex, None, 0
        with ExitStack() as held:
            out = {c: held.enter_context(fs.open_output_stream(f"{p}/{name}.{c}")) for c in reads}
            for batch in batches:
                for i in range(batch.num_rows):
                    first = batch.column("bucket")[i].as_py() if first is None else first
                    for c, read in reads.items():
                        got = read(batch.column(c)[i].as_py()).tobytes()
                        out[c].write(got)
                        size += len(got)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([name])], names=["first", "name"])

    dealt = rows.select("bucket", *reads).repartitionByRange(parts, "bucket").sortWithinPartitions("bucket")
    return sorted((r["first"], r["name"]) for r in dealt.mapInArrow(work, "first int, name string").collect())


def _load(path: str, name: str, dtype) -> np.ndarray:
    fs, p = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.asarray(np.memmap(f"{p}/{name}", dtype, "r"))
    with fs.open_input_file(f"{p}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


class _Held:
    """A model for the workers, in files of the shared folder."""

    def __init__(self, path: str, words: list, filters: list, start: np.ndarray, size: np.ndarray, total: int, rest: tuple):
        self.path, self.words, self.filters, self.start, self.size = path, words, filters, start, size
        self.total, self.rest, self.lambdas = total, rest, np.zeros(CLASSES)

    def get(self) -> Model:
        words = [(_load(self.path, f"{x}.keys", np.uint64), _load(self.path, f"{x}.data", np.uint64)) for _, x in self.words]
        filters = [(k, _load(self.path, f"{x}.data", np.uint8)) for k, x in self.filters]
        return Model(words, filters, self.start, self.size, self.total, *self.rest, self.lambdas)


def train(docs: DataFrame, text: str = "text", least: int = 1, base: float = 1.5, bits_per_key: int = 10, broadcast_bytes: int = 512 << 20, part_bytes: int = 32 << 20) -> _Held:
    """A model of all ``docs``, with lambdas of zero, in files of about ``part_bytes``.

    ``broadcast_bytes`` is taken from callers as before and has no effect: nothing is broadcast.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.count(F.lit(1))).first()[0]
    key_bits = min(64, max(32, int(size).bit_length() + 14))  # pairs: a false join in 16,000 at most
    n_words, n_pairs = buckets_for(size // 32), buckets_for(size // 6)

    def count(batches):
        for _, data, offs in blocks(batches, text, 2 << 20):
            tok, pair, _ = _tokens(data, offs)
            for kind, keys, bits, n in ((0, tok, 64, n_words), (1, pair >> U64(64 - key_bits), key_bits, n_pairs)):
                got = list(pieces(*np.unique(keys, return_counts=True), bits, n))
                b, k, c = zip(*got, strict=True) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(b), pa.int32()), pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["kind", "bucket", "keys", "counts"])

    def merge(key, table):
        k, n = merged([unpack_keys(x) for x in table.column("keys").to_pylist()], [unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
        kind, bucket = key[0].as_py(), key[1].as_py()
        if kind == 0:
            keys, data, bits = pack_keys(k), pack(n.astype(np.uint64)), 0
        else:
            k, n = k[n >= least], n[n >= least]
            q = levels(n, least, base)
            bits = min(1 << 32, max(64, int(q.sum()) * bits_per_key + 7 & ~7)) if len(k) else 0
            stretch = np.zeros(bits, np.uint8)
            for level in range(1, int(q.max(initial=0)) + 1):
                a, b = _hashes(k[q >= level], level)
                for j in range(HASHES):
                    stretch[_bit(a, b, j, U64(bits))] = 1
            keys, data = b"", np.packbits(stretch, bitorder="little").tobytes()
        length, total = (len(k), int(n.sum())) if kind == 0 else (len(data), 0)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "keys": pa.array([keys], pa.binary()), "data": pa.array([data], pa.binary()), "bits": pa.array([bits], pa.int64()), "length": pa.array([length], pa.int64()), "total": pa.array([total], pa.int64())})

    runs = docs.select(text).mapInArrow(count, "kind int, bucket int, keys binary, counts binary")
    made = staged(runs.groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket int, keys binary, data binary, bits bigint, length bigint, total bigint"), "counts")
    # a row a bucket, of 65,536 at most a kind
    start, size_of, length, total, at = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64), {0: 0, 1: 0}, 0, 0
    for r in made.select("kind", "bucket", "bits", "length", "total").orderBy("kind", "bucket").collect():
        length[r["kind"]] += r["length"]
        total += r["total"]
        if r["kind"] == 1:
            start[r["bucket"]], size_of[r["bucket"]] = at, r["bits"]
            at += r["bits"]

    path = scratch(docs.sparkSession, "lm")
    words = _save(made.where("kind = 0"), {"keys": unpack_keys, "data": lambda b: unpack(b, np.uint64)}, path, 1 + length[0] * 16 // part_bytes)
    filters = _save(made.where("kind = 1"), {"data": lambda b: np.frombuffer(b, np.uint8)}, path, 1 + length[1] // part_bytes)
    for k, (first, _) in enumerate(filters):  # places within each file
        end = filters[k + 1][0] if k + 1 < len(filters) else n_pairs
        start[first:end] -= start[first]
    return _Held(path, words, filters, start, size_of, total, (least, base, key_bits))


def fit_lambdas(docs: DataFrame, held: _Held, text: str) -> np.ndarray:
    """The grid value of each history class that leaves the left-out tokens of ``docs`` likeliest."""

    def work(batches):
        total = np.zeros((CLASSES, len(GRID)))
        m = held.get()
        for _, data, offs in blocks(batches, text, 2 << 20):
            total += m.left_out(data, offs)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    total = np.zeros((CLASSES, len(GRID)))
    for i, j, x in docs.select(text).mapInArrow(work, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        total[i, j] = x
    return GRID[np.where(total.any(axis=1), total.argmax(axis=1), 0)]


def score(docs: DataFrame, training: DataFrame, text: str = "text", least: int = 1, base: float = 1.5, broadcast_bytes: int = 512 << 20) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score, by a model of ``training``."""
    docs = fresh(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    held = train(training, text, least, base, broadcast_bytes=broadcast_bytes)
    held.lambdas = fit_lambdas(training, held, text)
    n = held.total
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches):
        m = held.get()
        for batch, data, offs in blocks(batches, text, 2 << 20):
            cols = [pa.array(x) for x in m.score(data, offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, cols[0].cast(pa.int64()), cols[1].cast(pa.int64()), pa.array(np.full(batch.num_rows, n)), cols[2], cols[3]], names=[*batch.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(work, f"{schema}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
