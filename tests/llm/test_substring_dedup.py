import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import substring_dedup as sd


def brute(texts, least):
    raw = [(x or "").encode() for x in texts]
    c = Counter(x[k : k + least] for x in raw for k in range(len(x) - least + 1))
    out = []
    for x in raw:
        m = bytearray(len(x))
        for k in range(len(x) - least + 1):
            if c[x[k : k + least]] > 1:
                m[k : k + least] = b"\1" * least
        out.append((len(x), sum(m), sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m))), hashlib.sha256(bytes(b for b, g in zip(x, m) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order_and_prefixes(seed):
    rng = random.Random(seed)
    segs = ["".join(rng.choice("aab" if seed % 2 else "abcdé") for _ in range(rng.randrange(1, 60))).encode() for _ in range(30)] + [b"a" * 40]
    t = np.frombuffer(b"\0".join(s.translate(sd._UP) for s in segs) + b"\0", np.uint8)
    wanted = (np.array([rng.random() < 0.7 for _ in t]) & (t > 0)) if seed > 1 else t > 0
    to_end = sd.distances(t)
    eights = sd._eights(t, to_end)
    got = sd.suffix_order(t, wanted, 64, to_end, eights)
    cut = [bytes(t[i : i + to_end[i]]) for i in got]
    assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist()
    assert cut == sorted(cut)
    pre = sd.common_prefixes(got, 64, to_end, eights)
    for k in range(1, len(cut)):
        n = 0
        while n < min(len(cut[k]), len(cut[k - 1])) and cut[k][n] == cut[k - 1][n]:
            n += 1
        assert pre[k] == n


def _texts():
    rng = random.Random(5)
    w = lambda n: " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    base, long_ = [w(80) for _ in range(12)], w(60)
    out = [*base, base[0], base[0], base[1][:-30] + w(5), "x" * 700, "é" * 300, None, "", "short", w(20) + long_ + w(10) + long_, w(3) + long_[13:], "\0" + long_ + "\0"]
    return out + [f"{w(4)} {long_} {w(4)}" for _ in range(20)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot, monkeypatch):
    texts = _texts()
    monkeypatch.setattr(sd, "BLOCK", 1 << 11)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in sd.remove_repeats(docs, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_empty_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n_bytes int")
    assert sd.remove_repeats(docs).count() == 0
    docs = spark.createDataFrame([(None, "a" * 500, 1), (None, None, 2)], "doc_id bigint, text string, n_bytes int")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in sd.remove_repeats(docs).collect()) == [(0, 0), (500, 500)]


def test_anchors_piece_by_piece():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abcde") for _ in range(n)) for n in (3000, 150, 0, 1200)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    prefix = sd.prefix_hash(data)
    windows = lambda got: {s: p for a, b, p in zip(*(x.tolist() for x in got), strict=True) for s in range(a, b + 1)}
    whole = windows(sd.anchors(data, offs, 200, prefix))
    assert whole == windows(sd.anchors(data, offs, 200, prefix, piece=333)) and len(whole) == 2801 + 1001


def test_one_text_thousands_of_times_and_near_copies(spark):
    base = _texts()[0] + _texts()[1]
    near = [base[: 5 * i] + "#" + base[5 * i + 1 :] for i in range(40)]
    docs = spark.createDataFrame([(i, base) for i in range(5000)] + [(5000 + i, x) for i, x in enumerate(near)], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in sd.remove_repeats(docs, hot=1000).collect()}
    want = brute([base, base, *near], 200)
    assert {got[i] for i in range(5000)} == {want[0]} and [got[5000 + i] for i in range(40)] == want[2:]
