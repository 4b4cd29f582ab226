"""Removal of long repeated byte strings by suffix arrays over parts of the corpus.

A byte is removed when some string of ``least`` bytes that covers it also starts anywhere else, in
the same document or another; texts are judged as they came. The corpus is too large for one
suffix array, so it is cut where equal strings meet:

1. Texts are packed into blocks of a few megabytes, written once to the shared folder.
2. Each window of ``least`` bytes has an anchor, its ``GRAM``-byte string of the least hash, at the
   same place in equal windows. Anchors that occur once in the corpus (counted exactly, in sorted
   runs) can't be in a repeated window; nothing more is done about theirs.
3. The windows of each remaining anchor are one segment. Segments go to the shard that their
   anchor's hash names; a shard so holds all windows that may equal each other. Segments that are
   alike are sent once a block, and enter the suffix array twice at most. The windows of an anchor
   with more than ``hot`` occurrences are cut into four segments by their distance from it, each dealt
   by the bytes that all its windows have; beyond ``16 * hot``, each window goes by its own hash.
4. Each shard's suffix array is built by two-stage sorting. Only the suffixes that are less than
   the ones after them are sorted directly; scanning the buckets of first bytes in ascending order
   puts each other suffix behind those of its bucket, by the order of its successor. Neighbours'
   common prefixes are measured, and windows with ``least`` common bytes are marked.
5. The marks go back to the blocks, where each text's marked windows are merged into runs.

Defined cases: a null text is empty; texts shorter than ``least`` keep all; repeated documents
remove each other; an empty table gives an empty result; input columns named like a computed one
are replaced. Texts are UTF-8, so the byte values above 0xF4 never occur and serve as separators.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import buckets_for, pack, pack_keys, pieces, unpack, unpack_keys
from ._shared import U64, mix, prefix_hash, scratch, span_hash, staged, text_block

GRAM = 32
BLOCK = 1 << 20
SHARD = 1 << 20


# ---------------------------------------------------------------- two-stage suffix sorting


def _types(t: np.ndarray) -> np.ndarray:
    """True for each suffix less than the one after it (equal bytes as the next that differs)."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    up[-1] = 1
    at = np.where(up != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return up[np.minimum(nxt, n - 1)] > 0


def _eights(t: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number, with zeros from the separator on."""
    n = len(t)
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out <<= U64(8)
        out[: n - j] |= t[j:]
    gone = np.flatnonzero(to_end < 8)
    return _masked(out, gone, to_end)


def _masked(out: np.ndarray, at: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    keep = (U64(8) - to_end[at].astype(np.uint64)) * U64(8)
    out[at] = np.where(keep >= 64, U64(0), (out[at] >> np.minimum(keep, U64(63))) << np.minimum(keep, U64(63)))
    return out


def _sort_directly(t: np.ndarray, to_end: np.ndarray, eights: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes there, to ``depth`` bytes or the separator; equal ones side by side.

    Suffixes alike to that depth (told by a hash of it) are sorted as one.
    """
    if not len(at):
        return at
    prefix = prefix_hash(t)
    h = span_hash(prefix, at, at + np.minimum(depth, to_end[at]))
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    rep = at[one]
    key = eights[rep]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    done = 8
    while done < depth:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        more = rep[order[tied]] + done
        live = to_end[rep[order[tied]]] > done
        key = np.where(live, eights[np.minimum(more, len(t) - 1)], U64(0))
        sub = np.lexsort((key, group[tied]))
        order[tied] = order[tied][sub]
        key, g = key[sub], group[tied][sub]
        new[tied] |= np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1])]
        done += 8
    rank = np.empty(len(rep), np.int64)
    rank[order] = np.arange(len(rep))
    return at[np.argsort(rank[back], kind="stable")]


def suffix_order(t: np.ndarray, wanted: np.ndarray, depth: int, to_end: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """The places where ``wanted`` is true, in the order of their suffixes (to ``depth`` bytes or a separator, byte 0).

    ``t`` ends with a separator. Suffixes needed only to induce others are sorted along.
    """
    n = len(t)
    small = _types(t)
    # an induced suffix needs its successor: all the way to the next one that is sorted directly
    pos = np.arange(n, dtype=np.int32)
    streak = np.maximum.accumulate(np.where(np.r_[True, small[:-1]], pos, np.int32(0)))  # where the run of larger ones before each place began
    need = np.maximum.accumulate(np.where(wanted, pos, np.int32(-1))) >= streak
    direct = _sort_directly(t, to_end, eights, np.flatnonzero(need & small), depth)
    heads = t[direct]
    cut = np.searchsorted(heads, np.arange(257)) if len(heads) else np.zeros(257, int)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)).tolist():
        mine, sorted_ = induced[c], direct[cut[c] : cut[c + 1]]
        wave = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        waves = [wave]
        while wave.size:  # runs of one byte are induced within their own bucket
            p = wave - 1
            p = p[p >= 0]
            wave = p[need[p] & ~small[p] & (t[p] == c)]
            waves.append(wave)
        both = np.concatenate([*waves, sorted_])
        if not both.size:
            continue
        out.append(both)
        p = both - 1
        p = p[p >= 0]
        p = p[need[p] & ~small[p] & (t[p] > c)]
        if p.size:
            first = t[p]
            order = np.argsort(first, kind="stable")
            first, p = first[order], p[order]
            edge = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(p)], strict=True):
                induced[first[x]].append(p[x:y])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, most: int, to_end: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it, up to ``most`` or a separator."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    most_of = np.minimum(np.minimum(to_end[order[1:]], to_end[order[:-1]]), most)
    live = np.arange(1, len(order))
    for k in range(0, most, 8):
        d = eights[np.minimum(order[live] + k, len(eights) - 1)] ^ eights[np.minimum(order[live - 1] + k, len(eights) - 1)]
        same = d == 0
        off = d[~same]
        out[live[~same]] = k + sum((off < (U64(1) << U64(b))).astype(np.int64) for b in range(8, 64, 8))
        live = live[same]
        out[live] = k + 8
        live = live[most_of[live - 1] > k + 8]
        if not live.size:
            break
    out[1:] = np.minimum(out[1:], most_of)
    return out


def distances(t: np.ndarray) -> np.ndarray:
    """Bytes from each place to the next separator."""
    pos = np.arange(len(t), dtype=np.int32)
    return np.minimum.accumulate(np.where(t == 0, pos, np.int32(len(t)))[::-1])[::-1] - pos


def repeated_windows(segments: list[bytes], windows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the segments, end to end with a separator after each, and where strings of ``least`` bytes begin that begin elsewhere too.

    Of segment i the first ``windows[i]`` starts are looked at.
    """
    t = np.frombuffer((b"\0".join(s.translate(_UP) for s in segments)) + b"\0", np.uint8)
    begin = np.cumsum([0, *(len(s) + 1 for s in segments)])[:-1]
    mark = np.zeros(len(t) + 1, np.int8)
    mark[begin] += 1
    np.add.at(mark, begin + windows, -1)
    wanted = np.cumsum(mark[:-1]) > 0
    to_end = distances(t)
    eights = _eights(t, to_end)
    order = suffix_order(t, wanted, least, to_end, eights)
    long_ = common_prefixes(order, least, to_end, eights) >= least
    hit = np.zeros(len(t), bool)
    hit[order[long_]] = True
    hit[order[np.flatnonzero(long_) - 1]] = True
    return begin, hit


#: Bytes of UTF-8 one up, so that 0 is free for separators.
_UP = bytes(min(b + 1, 255) for b in range(256))


# ---------------------------------------------------------------- anchors and segments


#: Bits of a place among the 64 of a hash and its place.
PLACE = 28


def anchors(data: np.ndarray, offs: np.ndarray, least: int, prefix: np.ndarray, piece: int = 1 << (PLACE - 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and place, of each anchor of the texts in a block; a long block goes piece by piece."""
    found = [_anchors(data, offs, least, prefix, at, min(len(data), at + piece + least - 1)) for at in range(0, max(len(data), 1), piece)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(whole: np.ndarray, offs: np.ndarray, least: int, prefix: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the windows that lie in [begin, end) of a block."""
    data, offs = whole[begin:end], np.clip(offs - begin, 0, end - begin)
    n, w = len(data), least - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    at = np.arange(n - GRAM + 1)
    # hash above, place below: of equal hashes the first place is least, in every copy of a window
    h = (span_hash(prefix, at + begin, at + begin + GRAM) & ~U64((1 << PLACE) - 1)) | at.astype(np.uint64)
    span, low = 1, h
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    k = len(h) - w + 1
    low = np.minimum(low[:k], low[w - span : w - span + k])
    ok = np.zeros(n, bool)
    length = np.diff(offs)
    full = np.flatnonzero(length >= least)
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, offs[full], 1)
    np.add.at(mark, offs[full] + length[full] - least + 1, -1)
    ok = np.cumsum(mark[:-1])[:k] > 0
    place = (low & U64((1 << PLACE) - 1)).astype(np.int64)
    start = np.flatnonzero(ok)
    if not len(start):
        return none, none, none
    p = place[start]
    cut = np.r_[True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(start)] - 1
    return start[first] + begin, start[last] + begin, p[first] + begin


def spread(f: np.ndarray, e: np.ndarray, place: np.ndarray, level: np.ndarray, anchor: np.ndarray, least: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and dealing hash of the segments of hot anchors with windows f to e.

    Level 1: windows by their distance from the anchor, in four ranges; equal windows have equal
    distances, and all windows of a range have its middle, by which it is dealt. Level 2: window by window.
    """
    wide = -(-(least - GRAM + 1) // 4)
    starts, ends, hashes = [], [], []
    one = np.flatnonzero(level == 1)
    for g in range(4):
        lo, hi = np.maximum(place - e, g * wide)[one], np.minimum(place - f, g * wide + wide - 1)[one]
        k = one[lo <= hi]
        middle = span_hash(prefix, place[k] - g * wide, place[k] - g * wide - wide + 1 + least)
        starts.append((place[one] - hi)[lo <= hi])
        ends.append((place[one] - lo + least)[lo <= hi])
        with np.errstate(over="ignore"):
            hashes.append(mix(anchor[k] + middle * U64(0x9E3779B97F4A7C15) + U64(g)))
    f, e, anchor = f[level == 2], e[level == 2], anchor[level == 2]
    n = e - f + 1
    s = np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        hashes.append(np.repeat(anchor, n) + span_hash(prefix, s, s + least) * U64(0x9E3779B97F4A7C15))
    return np.concatenate([*starts, s]), np.concatenate([*ends, s + least]), np.concatenate(hashes)


def _block_rows(batches):
    """Blocks of texts: (block, ids, offsets, data); a text beyond the block size is one by itself."""
    name, at = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0

    def out():
        nonlocal held, size, at
        ids = pa.concat_arrays([x for x, _, _ in held])
        offs = np.concatenate([[0], *[np.diff(o) for _, o, _ in held]]).cumsum().astype(np.int64)
        data = np.concatenate([d for _, _, d in held])
        row = pa.RecordBatch.from_arrays([pa.array([name + at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([offs.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["block", "ids", "offs", "data"])
        held, size, at = [], 0, at + 1
        return row

    for batch in batches:
        data, offs = text_block(batch, "t")
        i = 0
        while i < batch.num_rows:
            j = min(max(int(np.searchsorted(offs, offs[i] + BLOCK - size, "right")) - 1, i + (not held)), batch.num_rows)
            if j > i:
                held.append((batch.column("id").slice(i, j - i), offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]))
                size += int(offs[j] - offs[i])
            i = j
            if i < batch.num_rows or size >= BLOCK:
                yield out()
    if held:
        yield out()


def _open(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["data"].as_py(), np.uint8), np.frombuffer(row["offs"].as_py(), np.int64)


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {k: b.column(k)[i] for k in b.schema.names}


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_MARK = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])
_SEG = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("text", pa.binary()), ("len", pa.binary()), ("times", pa.binary()), ("owner", pa.binary()), ("start", pa.binary())])


def remove_repeats(docs: DataFrame, least: int = 200, hot: int = 4096, text: str = "text", row_id: str = "doc_id", with_text: bool = True) -> DataFrame:
    """(row id, n_bytes, n_removed, spans, kept_sha256[, kept_text]): ``spans`` are the removed runs of bytes.

    ``kept_text`` is decoded with cut characters dropped; the digest is of the remaining bytes.
    """
    spark = docs.sparkSession
    id_type = docs.schema[row_id].dataType.simpleString()
    table = f"tidewire_blocks_{uuid.uuid4().hex}"
    packed = docs.select(F.col(row_id).alias("id"), F.col(text).alias("t")).mapInArrow(_block_rows, f"block bigint, ids array<{id_type}>, offs binary, data binary")
    # bucketed by block, so that joining marks to blocks need not move the texts
    packed.write.bucketBy(max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").sortBy("block").option("path", scratch(spark, "blocks")).saveAsTable(table)
    store = spark.table(table)
    store.schema  # noqa: B018
    spark.sql(f"DROP TABLE {table}")  # the plan has the files and their buckets; nothing is left in the catalog
    size = store.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    buckets = buckets_for(2 * size // (least - GRAM + 2), 1 << 18)

    def count_anchors(batches):
        for row in _rows(batches):
            data, offs = _open(row)
            prefix = prefix_hash(data)
            first, last, place = anchors(data, offs, least, prefix)
            key = span_hash(prefix, place, place + GRAM)
            # a text has less than 2^31 bytes: the highest bit marks a segment's first occurrence in the block
            place[np.unique(span_hash(prefix, first, last + least), return_index=True)[1]] |= 1 << 31
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            got = [(b, row["block"].as_py(), k, v) for b, k, v in pieces(key, place, 64, buckets)]
            yield _table(got, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())]))

    def find_repeated(key, t):
        """Places of the anchors that occur twice or more, by block, with their levels, and the bytes of their segments."""
        keys = [unpack_keys(x) for x in t.column("keys").to_pylist()]
        place = [unpack(x, np.uint32) for x in t.column("places").to_pylist()]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        k, p = np.concatenate(keys), np.concatenate(place)
        order = np.argsort(k, kind="stable")
        k = k[order]
        group = np.cumsum(np.r_[False, k[1:] != k[:-1]])
        n = np.bincount(group)[group]
        again, new, p = order[n > 1], p >> 31, p & np.uint32((1 << 31) - 1)
        parts = (n[n > 1] > hot).astype(np.uint8) + (n[n > 1] > 16 * hot)
        by = np.lexsort((p[again], owner[again]))
        again, parts = again[by], parts[by]
        blocks = t.column("block").to_pylist()
        cut = np.flatnonzero(np.r_[True, owner[again][1:] != owner[again][:-1]]) if len(again) else []
        got = [(blocks[owner[again[x]]], pack(p[again[x:y]].astype(np.uint32)), pack(parts[x:y]), int((cost[parts[x:y]] * new[again[x:y]]).sum())) for x, y in zip(cut, [*cut[1:], len(again)], strict=True)] if len(again) else []
        return pa.Table.from_batches([_table(got, _MARK.append(pa.field("bytes", pa.int64())))])

    marks, w = "block bigint, at binary, n binary", least - GRAM + 1
    cost = np.array([least + w // 2, 4 * least + w, w * least])
    runs = store.select("block", "offs", "data").mapInArrow(count_anchors, "bucket int, block bigint, keys binary, places binary")
    repeated = staged(runs.groupBy("bucket").applyInArrow(find_repeated, marks + ", bytes bigint"), "anchors")
    gathered = repeated.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    shards = max(8, min((1 << 31) - 1, repeated.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // SHARD))

    def cut_segments(batches):
        for row in _rows(batches):
            data, offs = _open(row)
            prefix = prefix_hash(data)
            first, last, place = anchors(data, offs, least, prefix)
            at = np.concatenate([unpack(x, np.uint32) for x in row["at"].as_py()]).astype(np.int64)
            parts = np.concatenate([unpack(x, np.uint8) for x in row["n"].as_py()])
            order = np.argsort(at)
            at, parts = at[order], parts[order]
            # a place is the anchor of one run of windows, or of several around the end of a text
            k = np.minimum(np.searchsorted(at, place), len(at) - 1)
            keep = np.flatnonzero(at[k] == place)
            first, last, place, part = first[keep], last[keep], place[keep], parts[k[keep]]
            shard = span_hash(prefix, place, place + GRAM)
            cold = part == 0
            seg_s, seg_e, seg_h = first[cold], last[cold] + least, shard[cold]
            more = spread(first[~cold], last[~cold], place[~cold], part[~cold], shard[~cold], least, prefix)
            seg_s, seg_e, seg_h = np.r_[seg_s, more[0]], np.r_[seg_e, more[1]], np.r_[seg_h, more[2]]
            content = span_hash(prefix, seg_s, seg_e)
            to = (seg_h % U64(shards)).astype(np.int64)
            order = np.lexsort((seg_s, content, to))
            seg_s, seg_e, content, to = seg_s[order], seg_e[order], content[order], to[order]
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
            got = []
            for x, y in zip(cut, [*cut[1:], len(to)], strict=True) if len(to) else []:
                c = content[x:y]
                new = np.r_[True, c[1:] != c[:-1]]
                one = x + np.flatnonzero(new)
                owner = np.cumsum(new) - 1
                bytes_ = b"".join(data[a:b].tobytes() for a, b in zip(seg_s[one].tolist(), seg_e[one].tolist(), strict=True))
                length = (seg_e[one] - seg_s[one]).astype(np.uint32)
                got.append((int(to[x]), row["block"].as_py(), bytes_, pack(length), pack(np.minimum(np.bincount(owner), 2).astype(np.uint8)), pack(owner.astype(np.uint32)), pack(seg_s[x:y].astype(np.uint32))))
            yield _table(got, _SEG)

    def sort_shard(key, t):
        """Marked windows of a shard, by block: places and numbers of windows."""
        known: dict[bytes, int] = {}
        texts, times, of_row = [], [], []
        for text_, length, n in zip(t.column("text").to_pylist(), t.column("len").to_pylist(), t.column("times").to_pylist(), strict=True):
            ends = np.cumsum(unpack(length, np.uint32)).tolist()
            mine = []
            for a, b, m in zip([0, *ends[:-1]], ends, unpack(n, np.uint8).tolist(), strict=True):
                i = known.setdefault(text_[a:b], len(texts))
                if i == len(texts):
                    texts.append(text_[a:b])
                    times.append(0)
                times[i] += m
                mine.append(i)
            of_row.append(np.array(mine, np.int64))
        twice = [i for i, m in enumerate(times) if m > 1]
        all_ = [*texts, *(texts[i] for i in twice)]
        begin, hit = repeated_windows(all_, np.array([len(x) - least + 1 for x in all_], np.int64), least)
        d = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        run, size = d[::2], d[1::2] - d[::2]  # no run crosses segments: none begins near a segment's end
        first = np.searchsorted(run, begin[: len(texts)])
        count = np.searchsorted(run, begin[: len(texts)] + [len(x) for x in texts]) - first
        got = []
        for block, mine, owner, start in zip(t.column("block").to_pylist(), of_row, t.column("owner").to_pylist(), t.column("start").to_pylist(), strict=True):
            i, s = mine[unpack(owner, np.uint32)], unpack(start, np.uint32).astype(np.int64)
            n = count[i]
            if n.any():
                k = np.repeat(first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = run[k] - np.repeat(begin[i], n) + np.repeat(s, n)
                got.append((block, pack(at.astype(np.uint32)), pack(size[k].astype(np.uint32))))
        return pa.Table.from_batches([_table(got, _MARK)])

    seg_schema = "shard int, block bigint, text binary, len binary, times binary, owner binary, start binary"
    segments = store.select("block", "offs", "data").join(gathered, "block").mapInArrow(cut_segments, seg_schema)
    marked = staged(segments.groupBy("shard").applyInArrow(sort_shard, marks), "windows")
    covers = marked.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))

    def finish(batches):
        for row in _rows(batches):
            data, offs = _open(row)
            gone = np.zeros(len(data) + 1, np.int32)
            if row["at"].is_valid:
                for a, k in zip(row["at"].as_py(), row["n"].as_py(), strict=True):
                    s, m = unpack(a, np.uint32).astype(np.int64), unpack(k, np.uint32).astype(np.int64)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + m + least - 1, -1)
            gone = np.cumsum(gone[:-1]) > 0
            spans, removed, digest, texts = [], [], [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                g = gone[a:b]
                d = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                spans.append([{"start": x, "len": y - x} for x, y in zip(d[::2].tolist(), d[1::2].tolist(), strict=True)])
                removed.append(int(g.sum()))
                left = data[a:b][~g].tobytes() if len(d) else data[a:b].tobytes()
                digest.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "ignore") if with_text else "")
            cols = [row["ids"].values, pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(digest, pa.string())] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=[row_id, "n_bytes", "n_removed", "spans", "kept_sha256", *["kept_text"] * with_text])

    done = store.join(covers, "block", "left")
    return done.mapInArrow(finish, f"`{row_id}` {id_type}, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, len: bigint>>, kept_sha256 string" + ", kept_text string" * with_text)
