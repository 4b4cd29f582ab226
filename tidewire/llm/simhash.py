"""SimHash near-duplicates, linked by a generalised pigeonhole search.

Fingerprints of 64 bits are voted by the hashes of word shingles. Distinct fingerprints (copies are
one) are searched for others within ``distance`` bits: bits that go together are put into one of m
parts, and a dynamic program over estimated candidate counts gives each part its own threshold
t_i >= -1 with sum(t_i + 1) = distance + 1; a pair within the distance is within t_i in some part.
A part of threshold t is probed with all variants of its value within t bits, -1 not at all.
Candidates are verified by the bits that differ in the join itself.

A probed value shared by more than ``bucket`` fingerprints is not paired. Two fingerprints that
agree on a part and differ in at most ``distance`` of the other bits agree after some ``distance``
of those bits are cleared, and all that agree so are links of each other; each is linked to the
least of them. That is exact and grows with the bucket, not with its square.

``deduplicate`` groups texts by their fingerprints in the same way and verifies each group on the whole
shingle sets. Pairs of the similarity whose fingerprints lie further apart are then found by prefix
filtering, among the sets that the fingerprints left in different components, so that no pair is missed.

Defined cases: a text without words (or null) has fingerprint zero, linked like any other; repeated
rows have one fingerprint; null ids are never a component's id unless all of it have none; an
empty table gives an empty result; input columns named like a computed one are replaced.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runs import pack, pack_keys, pieces, unpack, unpack_keys
from ._shared import LOWER, SPACED, U64, arrow_batches, blocks, fresh, mix, prefix_hash, span_hash, staged, trimmed, word_spans


def _fingerprints(data: np.ndarray, offs: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    low = LOWER[data]
    s, e, row = word_spans(low, offs, SPACED)
    n = len(offs) - 1
    out = np.zeros(n, np.uint64)
    if not len(s):
        return out
    length = e - s
    to = np.cumsum(length + 1)
    at = to - length - 1
    joined = np.full(int(to[-1]), 32, np.uint8)  # the words again, one space after each
    src = np.repeat(s - at, length + 1)
    place = np.arange(len(joined))
    keep = np.ones(len(joined), bool)
    keep[to - 1] = False
    joined[keep] = low[(place + src)[keep]]
    count = np.bincount(row, minlength=n)
    last = np.cumsum(count)[row] - 1
    first = np.cumsum(count) - count
    i = np.arange(len(s))
    starts = np.flatnonzero((i + width - 1 <= last) | (i == first[row]))
    ends = np.minimum(starts + width - 1, last[starts])
    buf, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(buf[a:b], seed) for a, b in zip(at[starts].tolist(), (to[ends] - 1).tolist(), strict=True)], np.uint64)
    doc = row[starts]
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    votes = np.empty((len(cut), 64), np.int64)
    for lo in range(0, len(cut), 256):  # bits of some documents at a time
        b = cut[lo : lo + 256]
        end = cut[lo + 256] if lo + 256 < len(cut) else len(h)
        bits = np.unpackbits(h[b[0] : end].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        for k, (x, y) in enumerate(zip(b - b[0], np.r_[b[1:], end] - b[0], strict=True)):
            votes[lo + k] = bits[x:y].sum(axis=0, dtype=np.int64)
    size = np.diff(np.r_[cut, len(h)])
    ones = (2 * votes > size[:, None]).astype(np.uint8)
    out[doc[cut]] = np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""
    docs = fresh(docs, "fp")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches):
        for batch, data, offs in blocks(batches, text):
            fp = pa.array(_fingerprints(data, offs, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(work, f"{schema}, fp bigint")


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints, and how often each pair of bits is set together."""

    def count(batches):
        both = np.zeros((64, 64), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1 << 16):
                x = b.column("fp").to_numpy()[at : at + (1 << 16)].view(np.uint64)
                bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": both[i, j]})

    both = np.zeros((64, 64))
    for i, j, n in fps.select("fp").mapInArrow(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = n
    return fps.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size: each bit joins the open group that it correlates with most."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    size = [64 // parts + (k < 64 % parts) for k in range(parts)]
    free, out = set(range(64)), []
    for k in range(parts):
        seed = max(sorted(free), key=lambda b: max((corr[b, c] for c in free if c != b), default=0))
        group = [seed]
        free.discard(seed)
        while len(group) < size[k]:
            nxt = max(sorted(free), key=lambda b: sum(corr[b, c] for c in group))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds from -1 that sum to distance + 1 - parts at least cost; cost[i][t + 1] is of part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance - used + 1):
                if used + t + 1 <= distance + 1 and (used + t + 1 not in nxt or c + row[t + 1] < nxt[used + t + 1][0]):
                    nxt[used + t + 1] = (c + row[t + 1], [*ts, t])
        best = nxt
    return best[distance + 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: A part with more variants to probe than this is never chosen.
MOST_PROBES = 4096


def _probes(bits: int, t: int) -> float:
    n = sum(math.comb(bits, j) for j in range(t + 1))
    return float(n) if n <= MOST_PROBES else 1e12


def plan(fps: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """The grouping of bits and the thresholds of least estimated work, over 1 to distance + 1 parts."""
    n, both = _bit_statistics(fps)
    differ = np.clip(2 * (np.diag(both) / max(n, 1)) * (1 - np.diag(both) / max(n, 1)), 1e-9, 0.5)
    best = None
    for m in range(1, distance + 2):
        groups = group_bits(n, both, m)
        masks = [_signed(sum(1 << b for b in g)) for g in groups]
        same = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for i, x in enumerate(masks)])).alias("k")).groupBy("k.i", "k.v").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)))
        pairs = dict(same.collect()) if n else {}
        cost = []
        for i, g in enumerate(groups):
            q = differ[g] / (1 - differ[g])
            ways = [q.sum() ** j / math.factorial(j) for j in range(distance + 1)]
            cost.append([0.0] + [0.5 * pairs.get(i, 0.0) * sum(ways[: t + 1]) + n * _probes(len(g), t) for t in range(distance + 1)])
        total, ts = allocate(cost, distance)
        if best is None or total < best[0]:
            best = (total, groups, ts)
    return best[1], best[2]


def _hot_links(own: DataFrame, hot: DataFrame, group: list[int], t: int, distance: int) -> DataFrame:
    """Links of the fingerprints at or near the part values in ``hot``: all that agree in value, flip and kept bits, to the least of them."""
    full = (1 << 64) - 1
    mask = sum(1 << b for b in group)
    rest = [b for b in range(64) if not mask >> b & 1]
    out = None
    for k in range(min(t, distance) + 1):
        flips = [_signed(sum(1 << b for b in c)) for c in itertools.combinations(group, k)]
        clears = [_signed(full ^ mask ^ sum(1 << b for b in c)) for c in itertools.combinations(rest, min(distance - k, len(rest)))]
        flipped = own.select("fp", "v", F.explode(F.array(*map(F.lit, flips))).alias("f"))
        held = flipped if k == 0 else flipped.union(flipped.select("fp", F.col("v").bitwiseXOR(F.col("f")), "f"))
        keyed = held.join(hot, "v", "left_semi").select("fp", "v", "f", F.explode(F.array(*map(F.lit, clears))).alias("c")).withColumn("k", F.col("fp").bitwiseAND(F.col("c")))
        least = keyed.groupBy("v", "f", "c", "k").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
        star = keyed.join(least, ["v", "f", "c", "k"]).where(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
        out = star if out is None else out.unionByName(star)
    return out


def links(fps: DataFrame, distance: int = 2, bucket: int = 512, grouping: tuple[list[list[int]], list[int]] | None = None) -> DataFrame:
    """(a, b), a < b: links among the distinct fingerprints ``fps``, enough to connect all pairs within ``distance``.

    Every pair within the distance is linked directly, or through others within it of both.
    """
    groups, ts = grouping or plan(fps, distance)
    out = fps.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))  # rows from Python would start a second family of workers
    for g, t in zip(groups, ts, strict=True):
        if t < 0:
            continue
        mask = sum(1 << b for b in g)
        part = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in itertools.combinations(g, k)]
        own = fps.select("fp", part.alias("v"))
        sizes = own.groupBy("v").count()
        hot = staged(sizes.where(F.col("count") > bucket).select("v"), "hot")
        cool = own.join(sizes.where((F.col("count") > (1 if t == 0 else 0)) & (F.col("count") <= bucket)).select("v"), "v", "left_semi")
        probes = own if t == 0 else own.select("fp", F.explode(F.array(*[F.col("v").bitwiseXOR(F.lit(x)) for x in flips])).alias("v"))
        near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
        pairs = probes.alias("x").join(cool.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.fp") != F.col("y.fp")) & near)
        out = out.unionByName(pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")))
        if not hot.isEmpty():  # these plans hold thousands of masks and some ten exchanges, which the driver pays for
            out = out.unionByName(_hot_links(own, hot, g, t, distance))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for all nodes with an edge.

    Large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder; they
    end when the number and the sum of the edges stay as they are.
    """
    edges = staged(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.withColumnRenamed("b", "u").join(low, "u")
        edges = staged(small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def classes(rows: DataFrame, distance: int, bucket: int = 512) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``rows``: the least fingerprint of its component."""
    fps = staged(rows.select("fp").distinct(), "distinct")
    roots = components(links(fps, distance, bucket))
    return staged(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2, text: str = "text", row_id: str = "doc_id", bucket: int = 512) -> DataFrame:
    """(row id, fp, component_id): the class of each document, named by the least id in it."""
    rows = staged(fingerprints(docs.select(row_id, text), width, text).select(row_id, "fp"), "fingerprints")
    of = classes(rows, distance, bucket)
    least = rows.groupBy("fp").agg(F.min(row_id).alias("least"))
    names = of.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = of.join(names, "root").select(F.col("fp").alias("__tw_fp"), "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("__tw_fp"), "left").select(row_id, "fp", "component_id")


#: Bytes of text that a worker of ``deduplicate`` works on at once: what it takes of memory is some 80 times that.
BLOCK = 1 << 18


def _shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, end to end, and the n + 1 offsets of the documents."""
    low = LOWER[data]
    s, e, row = word_spans(low, offs, SPACED)
    n = len(offs) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = span_hash(prefix_hash(low), s, e)
    count = np.bincount(row, minlength=n)
    end = np.cumsum(count)
    i, last = np.arange(len(s)), end[row] - 1
    starts = np.flatnonzero((i + width - 1 <= last) | (i == (end - count)[row]))
    h = np.zeros(len(starts), np.uint64)
    for j in range(width):  # a text of fewer words is one shingle
        live = np.flatnonzero(starts + j <= last[starts])
        with np.errstate(over="ignore"):
            h[live] = mix(h[live] * U64(0x9FB21C651E98DF25) + word[starts[live] + j])
    doc = row[starts]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    return h[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=n))]


def _set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each document's set; 0 for an empty one."""
    sums = np.r_[U64(0), np.cumsum(mix(h ^ U64(0xD6E8FEB86659FD93)), dtype=np.uint64)]
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def _parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """512 bits of each set, each the parity of the shingles that fall on it: two sets differ in as many shingles at least as in bits."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    odd = np.bincount(doc * 512 + (mix(h ^ U64(0xA24BAED4963EE407)) >> U64(55)).astype(np.int64), minlength=512 * (len(at) - 1)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 512), axis=1).view(np.int64)


BITS = [f"p{i}" for i in range(8)]


def _levels(docs: DataFrame, width: int, text: str, bits: int = 24, slices: int = 64) -> np.ndarray:
    """How often shingles of each of 2**bits buckets occur, in eighths of a doubling: what orders shingles, rare ones first.

    Any order of shingles is right, so buckets that shingles share cost candidates, never links. A task
    sends the buckets of about half a million shingles at a time in packed slices; slices are added up for every
    256 tasks, then over all, one slice after the other: the size of the result is fixed, and so is a worker's memory.
    """
    low = (1 << bits) // slices

    def rows(p, t, k, n):
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(t, pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], names=["p", "t", "k", "n"])

    def count(batches):
        t = TaskContext.get().partitionId() >> 8
        held, n_held = [], 0
        for _, data, offs in itertools.chain(blocks(batches, text, BLOCK), [(None, None, None)]):
            if data is not None:
                held.append(_bucket(_shingle_sets(data, offs, width)[0], bits).astype(np.uint32))
                n_held += len(held[-1])
            if n_held and (data is None or n_held >= 1 << 19):
                at, n = np.unique(np.concatenate(held), return_counts=True)
                held, n_held = [], 0
                p, k, c = zip(*pieces(at.astype(np.uint64), n, bits, slices), strict=True)
                yield rows(p, [t] * len(p), k, c)

    def summed(batches):
        slice_, sums = None, np.zeros(0, np.int64)
        for batch in batches:
            for p, k, n in zip(*(batch.column(c).to_pylist() for c in ("p", "k", "n")), strict=True):
                if p != slice_:
                    if slice_ is not None:
                        yield slice_, sums
                    slice_, sums = p, np.zeros(low, np.int64)
                sums[unpack_keys(k).astype(np.int64) - p * low] += unpack(n, np.uint32)
        if slice_ is not None:
            yield slice_, sums

    def add(batches):
        for p, a in summed(batches):
            at = np.flatnonzero(a)
            yield rows([p], [0], [pack_keys((at + p * low).astype(np.uint64))], [pack(np.minimum(a[at], (1 << 32) - 1).astype(np.uint32))])

    def level(batches):
        for p, a in summed(batches):
            steps = np.minimum(np.rint(8 * np.log2(1 + a)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["p", "x"])

    schema = "p int, t int, k binary, n binary"
    parts = docs.select(text).mapInArrow(trimmed(count), schema).repartition("p", "t").sortWithinPartitions("p").mapInArrow(trimmed(add), schema)
    got = parts.repartition("p").sortWithinPartitions("p").mapInArrow(trimmed(level), "p int, x binary").toArrow()
    out = np.zeros((slices, low), np.uint8)
    for p, x in zip(got.column("p").to_pylist(), got.column("x").to_pylist(), strict=True):
        out[p] = np.frombuffer(x, np.uint8)
    return out.ravel()


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return mix(h ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - bits)


def _prefixes(docs: DataFrame, width: int, similarity: float, text: str) -> DataFrame:
    """(k, s, n, i): the first shingles, rare ones first, of each set s of n shingles, and their places i from 0."""
    held = docs.sparkSession.sparkContext.broadcast(_levels(docs, width, text))

    def work(batches):
        levels = held.value
        bits = len(levels).bit_length() - 1
        seen: set[int] = set()
        for _, data, offs in blocks(batches, text, BLOCK):
            h, at = _shingle_sets(data, offs, width)
            size = np.diff(at)
            keys = _set_keys(h, at)
            new = np.array([not (x in seen or seen.add(x)) for x in keys.tolist()])  # a task sends a set once
            doc = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, levels[_bucket(h, bits).astype(np.int64)], doc))
            first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            place = np.arange(len(h)) - at[doc]
            m = place < (first * new)[doc]
            take = order[m]
            yield pa.RecordBatch.from_pydict({"k": h[take].view(np.int64), "s": keys[doc[take]], "n": size[doc[take]], "i": place[m].astype(np.int32)})

    return docs.select(text).mapInArrow(trimmed(work), "k bigint, s bigint, n bigint, i int")


#: Bytes that a shingle's hash takes when sets are compared.
PLACES = 6


def _packed(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :PLACES].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // PLACES, 8), np.uint8)
    wide[:, :PLACES] = np.frombuffer(b, np.uint8).reshape(-1, PLACES)
    return np.sort(wide.view(np.uint64).ravel())


def _verified(pairs: DataFrame, docs: DataFrame, least: DataFrame, width: int, similarity: float, text: str, broadcast_rows: int) -> DataFrame:
    """Those pairs (a, b) of sets whose Jaccard similarity, on the whole sets, is ``similarity`` or more.

    Only documents with a pair left after the bound of their parities are read for their sets. Each goes to its
    leaders ``a``, in parts of about a million shingles, and the leader to each of its parts, where
    the sets stream past it: a leader of many is dealt over tasks, and no pair of sets is ever a row.
    """
    bits = lambda side: least.select(F.col("s").alias(side), F.col("n").alias(f"{side}n"), *[F.col(p).alias(f"{side}{p}") for p in BITS])
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in BITS), F.lit(0))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("an") + F.col("bn")) + 1e-6
    pairs = staged(pairs.join(bits("b"), "b").join(bits("a"), "a").where(apart <= most).select("a", "b", "bn"), "pairs")
    load = pairs.groupBy("a").agg(F.ceil(F.sum("bn") / F.lit(1 << 20)).alias("parts"))
    dealt = pairs.join(load, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "b", "part")
    sends = dealt.select(F.col("b").alias("s"), "a", "part").union(dealt.select("a", "a", "part").distinct())
    wanted = sends.join(least.select("s", F.col("m.r0").alias("__tw_0"), F.col("m.r1").alias("__tw_1")), "s")
    wanted = staged(wanted.groupBy("__tw_0", "__tw_1", "s").agg(F.collect_list(F.struct("a", "part")).alias("to")), "wanted")
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    schema = "a bigint, part bigint, s bigint, x binary"

    def send(batches):
        names = ["a", "part", "s", "x"]
        for batch, data, offs in blocks(batches, text, BLOCK):
            h, at = _shingle_sets(data, offs, width)
            out, size = [], 0
            for i in range(batch.num_rows):
                s, x = batch.column("s")[i].as_py(), _packed(h[at[i] : at[i + 1]])
                for to in batch.column("to")[i].as_py():
                    out.append((to["a"], to["part"], s, x))
                    size += len(x)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    def compare(batches):
        leader, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, s, sets = batch.column("a").to_pylist(), batch.column("s").to_pylist(), batch.column("x")
            alike = []
            for i in range(batch.num_rows):
                if s[i] == a[i]:
                    leader, x = a[i], _unpacked(sets[i].as_py())
                    continue
                y = _unpacked(sets[i].as_py())
                both = int((x[np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))] == y).sum()) if len(x) and leader == a[i] else 0
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    alike.append((a[i], s[i]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in alike], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sent = docs.join(wanted, ["__tw_0", "__tw_1"]).select(text, "s", "to").mapInArrow(trimmed(send), schema)
    met = sent.repartition("a", "part").sortWithinPartitions("a", "part", (F.col("s") != F.col("a")).cast("int"), "s")
    return staged(met.mapInArrow(trimmed(compare), "a bigint, b bigint").distinct(), "similar")


def close_sets(marks: DataFrame, distance: int, bucket: int = 512) -> DataFrame:
    """(a, b): each set ``b`` with the set ``a`` of the least document among those whose fingerprints are in its class.

    ``marks`` (s, fp, m) has a row of each set and fingerprint: repeats within a text change the fingerprint, not the set.
    """
    named = marks.join(classes(marks, distance, bucket), "fp").select("root", "s", "m")
    first = named.groupBy("root").agg(F.min(F.struct("m", "s")).alias("l")).select("root", F.col("l.s").alias("a"))
    return named.join(first, "root").where(F.col("s") != F.col("a")).select("a", F.col("s").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets are in different components."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}r"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ar", "a") != F.coalesce("br", "b")).select("a", "b")


def similar_sets(docs: DataFrame, least: DataFrame, close: DataFrame, width: int, similarity: float, text: str, broadcast_rows: int = 1 << 18) -> DataFrame:
    """(node, root) of the sets in a component of pairs with Jaccard similarity ``similarity`` or more; each pair is verified on the whole sets.

    The pairs ``close`` that fingerprints give come first. For the rest candidates share a shingle of their
    prefixes (Chaudhuri et al. 2006), so that no pair is missed: two sets that
    must have o shingles in common share one of the first |x| - o + 1 of each, and o is known once both sizes
    are (Xiao et al. 2008). With common shingles last, a passage that many texts quote lies beyond these. First
    each set is compared with the one that has a shingle at the least place, as the text that near copies were made
    from has, then those with each other that are in different
    components yet. Sets in one component are not compared again. ``least`` (s, m, n, parities) has a row of each set.
    """
    verified = lambda pairs: _verified(pairs, docs, least, width, similarity, text, broadcast_rows)
    close = staged(close, "close")
    found = verified(close)
    roots = components(found)
    post = _prefixes(docs, width, similarity, text).repartition("k").distinct()  # one exchange, also for the window
    led = post.selectExpr("*", "min(struct(i, s, n)) OVER (PARTITION BY k) AS l", "min(s) OVER (PARTITION BY k) AS y", "max(s) OVER (PARTITION BY k) AS z").where("y < z")
    posts = staged(led.select("k", "s", "n", "i", F.col("l.s").alias("a"), F.col("l.n").alias("an"), F.col("l.i").alias("ai")), "postings")
    stars = posts.toDF("k", "b", "bn", "bi", "a", "an", "ai").where((F.col("b") != F.col("a")) & _within(similarity)).select("a", "b").distinct()
    stars = staged(_apart(stars, roots), "stars")
    found = found.union(verified(stars))
    roots = components(found)
    named = posts.select("k", "s", "n", "i").join(roots, F.col("s") == F.col("node"), "left").select("k", "s", "n", "i", F.coalesce("root", "s").alias("root"))
    named = staged(named, "named")
    apart = named.groupBy("k").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u < v").select("k")
    rest = staged(named.join(apart, "k", "left_semi"), "apart")
    x, y = rest.toDF("k", "a", "an", "ai", "ar"), rest.toDF("k", "b", "bn", "bi", "br")
    pairs = x.join(y, (x["k"] == y["k"]) & (F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")) & _within(similarity)).select("a", "b").distinct()
    done = stars.union(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return components(found.union(verified(pairs.join(done, ["a", "b"], "left_anti"))))


def _within(similarity: float) -> Column:
    """Sizes an, bn that allow the similarity, and a shared shingle at places ai, bi that both prefixes for these sizes hold."""
    common = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("an") + F.col("bn")) - 1e-6)
    near = F.least("an", "bn") >= F.greatest("an", "bn") * F.lit(similarity) - 1e-9
    return near & (F.col("ai") <= F.col("an") - common) & (F.col("bi") <= F.col("bn") - common)


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", row_id: str = "doc_id", distance: int = 2) -> DataFrame:
    """One row of ``docs``, that of the least id, for each component of pairs whose shingle sets have the similarity or more.

    ``distance`` is that of the fingerprints that are linked first; it changes the work, not the result.
    Rows that share an id but not a text are told apart by a 128-bit hash of both; of rows alike in
    both, one stays. Rows with a null id stand for their group only where no row of it has an id.
    """
    names = ("__tw_0", "__tw_1")
    hashed = fresh(docs, *names).withColumns({n: F.xxhash64(F.lit(k), F.col(row_id), F.lit(k), F.col(text)) for k, n in enumerate(names)})
    only = hashed.select(row_id, text, *names)

    def keys(batches):
        for batch, data, offs in blocks(batches, text, BLOCK):
            h, at = _shingle_sets(data, offs, width)
            more = [_fingerprints(data, offs, width).view(np.int64), _set_keys(h, at), np.diff(at), *np.ascontiguousarray(_parities(h, at).T)]
            yield pa.RecordBatch.from_arrays([batch.column(row_id), *(batch.column(n) for n in names), *map(pa.array, more)], names=[row_id, *names, "fp", "s", "n", *BITS])

    rows = only.mapInArrow(trimmed(keys), f"`{row_id}` {only.schema[row_id].dataType.simpleString()}, __tw_0 bigint, __tw_1 bigint, fp bigint, s bigint, n bigint, " + ", ".join(f"{p} bigint" for p in BITS))
    first = F.min(F.struct(F.col(row_id).isNull().alias("none"), F.col(row_id).alias("id"), F.col("__tw_0").alias("r0"), F.col("__tw_1").alias("r1")))
    most = [F.max(c).alias(c) for c in ("n", *BITS)]
    with arrow_batches(docs.sparkSession):
        marks = staged(rows.groupBy("s", "fp").agg(first.alias("m"), *most), "marks")
        least = staged(marks.groupBy("s").agg(F.min("m").alias("m"), *most), "least")
        roots = similar_sets(only, least, close_sets(marks, distance), width, similarity, text)
        of = least.join(roots, F.col("s") == F.col("node"), "left").select("m", F.coalesce("root", "s").alias("root"))
        kept = staged(of.groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.r0").alias("__tw_0"), F.col("m.r1").alias("__tw_1")), "kept")
    # the join and what follows it are dealt by the same two columns: texts move once
    return hashed.join(kept, list(names), "left_semi").dropDuplicates(list(names)).drop(*names)
