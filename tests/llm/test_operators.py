"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewire.llm import decontaminate, language_id, language_model, mixing, quality_knn, quality_rules, sharding, simhash, token_files

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}é" if rng.random() < 0.1 else f"w{rng.randrange(k)}" for _ in range(n))


def frame(spark, texts, more="", extra=()):
    rows = [(i, t, *extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + more).repartition(3)


ODD = [None, "", " \n\t ", "word", "A b. C-d!", "x" * 5000, "#$%\n\n", "\x00a\x0bb"]


# ---------------------------------------------------------------- 1


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    items = [(k, words(rng, rng.choice([3, 8, 9, 20, 40]))) for k in range(25)] + [(25, None), (26, "!!"), (None, "a b c"), (3, "solo"), (27, "Tie tie TIE tie tie tie tie tie tie")]
    texts = [*ODD, "solo", "a tie " * 12]
    for _ in range(60):
        t = words(rng, rng.randrange(5, 80))
        for _ in range(rng.randrange(3)):
            w = (items[rng.randrange(25)][1]).split()
            a = rng.randrange(len(w))
            t += " " + ", ".join(w[a : a + rng.randrange(5, 20)]).upper() + " " + words(rng, 5)
        texts.append(t)
    tok = lambda t: ALNUM.findall((t or "").encode().lower())
    wins = [(str(i), tuple(w[k : k + 8])) for i, t in items if i is not None for w in [tok(t)] if w for k in range(max(1, len(w) - 7))]
    docs = frame(spark, texts, ", items int, n_hit string", (7, "z"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 200):
        got = {r["doc_id"]: r for r in decontaminate.search(docs, bench, block_bytes=block, shard_bytes=3000).collect()}
        for i, t in enumerate(texts):
            w, hit, found = tok(t), set(), set()
            for item, win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(item)
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found)), i
            for m in got[i]["matches"]:
                item = [x for n, x in items if str(n) == m["item_id"]]
                assert any(tok(x)[m["item_start"] : m["item_start"] + m["len"]] == w[m["doc_start"] : m["doc_start"] + m["len"]] for x in item)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {i for i in got if got[i]["n_items"] < 2 and not any(m["len"] >= 8 for m in got[i]["matches"])}
    assert decontaminate.search(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.search(docs.limit(0), bench).count() == 0


# ---------------------------------------------------------------- 2


def test_shards(spark):
    rng = random.Random(2)
    texts = [*ODD, *[words(rng, rng.randrange(1, 60)) for _ in range(900)], *["same text here"] * 500]
    out = sharding.shard(frame(spark, texts, ", slot string", ("q",)), n_shards=8, run_bytes=500).toPandas()
    assert sorted(out.doc_id) == list(range(len(texts))) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    for r in out.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= 2 * out["size"].max() + 0.01 * size.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.shard(frame(spark, texts), n_shards=8, run_bytes=500).toPandas()
    assert dict(zip(out.doc_id, zip(out.shard, out.slot))) == dict(zip(again.doc_id, zip(again.shard, again.slot)))
    assert sharding.shard(frame(spark, texts).limit(0)).count() == 0
    one = sharding.shard(spark.createDataFrame([(None, None), (None, None), (1, "a")], "doc_id bigint, text string")).toPandas()
    assert len(one) == 3 and all(sorted(g.slot) == list(range(len(g))) for _, g in one.groupby("shard"))


def test_shards_cut_a_text_with_a_third_of_all_bytes(spark):
    rng = random.Random(15)
    texts = [*[words(rng, 40) for _ in range(800)], *[words(random.Random(0), 40)] * 400]
    docs = frame(spark, texts)
    out = sharding.shard(docs, n_shards=16, tolerance=0.05).toPandas()
    assert sorted(out.doc_id) == list(range(1200))
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() - size.min() <= 2 * out["size"].max() + 0.1 * size.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


# ---------------------------------------------------------------- 3


def _rules(t):
    t = t or ""
    w = SPACED.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    rng = random.Random(3)
    texts = [*ODD, "a b c a b c", "a a a a", "a a a", "x y x y x y x", "l\nl\n l\nl", *["\n".join(words(rng, rng.randrange(0, 12), 9) for _ in range(8)) for _ in range(80)], *[words(rng, 120, 4000) for _ in range(250)], *["& | # " * 40 + words(rng, 60, 999) for _ in range(5)]]
    docs = frame(spark, texts, ", lang string, source string, kept int", ("en", None, 3))
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, chars, sym, dup, rep = _rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep), (i, t)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])
    assert not any(got[i]["kept"] for i in range(len(texts) - 5, len(texts))) and sum(r["kept"] for r in got.values()) >= 245
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_sketch_bins(spark):
    from pyspark.sql import functions as F

    for v, b in spark.range(0, 5000).select("id", quality_rules.bin_of(F.col("id")).alias("b")).collect():
        assert b <= v and (b == v if v < 64 else v - b < max(1, v / 32 + 1))


# ---------------------------------------------------------------- 4


def test_language_spans(spark):
    rng = random.Random(4)
    en, de = "the of and that with have this from they".split(), "der die und nicht ein auch mit sich für".split()
    ru = "и не на что он как это по но".split()
    make = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(i, make([en, de, ru][i % 3], 30), ["en", "de", "ru"][i % 3]) for i in range(150)] + [(900, "x", None), (901, None, "en")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = [None, "", "123 !!", make(en, 20) + " " + make(de, 30), make(ru, 5), "日本語", make(de, 5000), "²"]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, texts, ", score string", ("s",)), model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[7]["lang_pred"] == "und"
    assert got[3]["lang_pred"] == "de" and 0.5 < got[3]["score"] < 0.7 and [(s["lang"], s["words"]) for s in got[3]["spans"]] == [("en", 20), ("de", 30)]
    assert got[4]["lang_pred"] == "ru" and got[5]["lang_pred"] in ("en", "de", "ru") and got[5]["score"] == 0 and got[6]["lang_pred"] == "de"
    none = language_id.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, texts), none).collect()} == {"und"}
    assert language_id.identify(frame(spark, texts).limit(0), model).count() == 0


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7):
        s = rng.normal(size=(n, 3)).astype(np.float32) * 4
        got = language_id.viterbi(s, np.array([0]), np.array([n]), 2.0)
        cost = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        import itertools

        assert cost(got.tolist()) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=n))), abs=1e-4)


def language_worker(spark, monkeypatch):
    """What a Python worker runs over its Arrow batches, with a model of two languages."""
    rng = random.Random(5)
    en, de = "the and of to in is that it for was".split(), "der und die zu in ist das es für war".split()
    make = lambda v, n: " ".join(rng.choices(v, k=n))
    model = language_id.fit(spark.createDataFrame([(i, make([en, de][i % 2], 30), ["en", "de"][i % 2]) for i in range(100)], "doc_id bigint, text string, lang string"))
    docs = frame(spark, ["x"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    texts = [*ODD, "日本語" * 300, make(en, 400) + " " + make(de, 300) + " " + "ü" * 700, *[make(rng.choice([en, de]), rng.randrange(60)) for _ in range(40)]]
    batch = lambda texts: pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    return language_id.identify(docs, model), lambda n: make(en, n), batch, texts


def test_language_worker_memory_does_not_follow_the_batch(spark, monkeypatch):
    work, make, batch, _ = language_worker(spark, monkeypatch)
    for rows in (batch([make(300) for _ in range(12_000)]), batch(["w" * (12 << 20)])):  # 12 MB of texts, and of one word
        tracemalloc.start()
        got = sum(b.num_rows for b in work(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == rows.num_rows and peak < 160 << 20


def test_languages_are_the_same_in_any_pieces(spark, monkeypatch):
    work, _, batch, texts = language_worker(spark, monkeypatch)
    rows = lambda: [r for b in work(iter([batch(texts), batch(texts[::-1])])) for r in b.to_pylist()]
    whole = rows()
    assert [r["text"] for r in whole] == texts + texts[::-1] and {r["lang_pred"] for r in whole} == {"und", "en", "de"}
    for piece, room in ((64, 1), (1000, 40_000), (1 << 18, 1)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "ROOM", room)
        for r, w in zip(rows(), whole, strict=True):
            assert (r["doc_id"], r["lang_pred"], r["spans"]) == (w["doc_id"], w["lang_pred"], w["spans"]) and r["score"] == pytest.approx(w["score"])


# ---------------------------------------------------------------- 6


def test_token_files(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [*ODD, "a<|endoftext|>b", "Straße ÀÉ I'LL don't 12½ é́    x \x1cq Σς İ 日本", *[words(rng, rng.randrange(50)) for _ in range(40)]]
    ids = [rng.randrange(-50, 500) for _ in texts]
    ids[3] = ids[4]
    rows = list(zip(ids, texts, strict=True)) + [(None, "null id")]
    out = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, out, end_id=2, parts=3)
    got = token_files.read_tokens(spark, out, with_ids=True).collect()
    got.sort(key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(ids)
    at, want = 0, Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), path, str(tmp_path / "e"), end_id=2)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_language_model(spark, bound):
    rng = random.Random(7)
    texts = [*ODD, *[" ".join(x for _ in range(20) for x in (f"A{rng.randrange(30)}", f"b{rng.randrange(5)}", "c")) for _ in range(60)]]
    docs = frame(spark, texts, ", score string", ("s",))
    got = {r["doc_id"]: r for r in language_model.score(docs, docs.where("doc_id % 7 <> 2"), broadcast_bytes=bound).collect()}
    low = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    c = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in low(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = low(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert language_model.score(docs.limit(0), docs).count() == 0 and language_model.score(docs, docs.limit(0)).count() == len(texts)


def test_counts_come_back_from_the_filter(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(30)]
    m = language_model.train(frame(spark, texts)).get()
    pairs = Counter()
    for t in texts:
        w = t.split()
        pairs.update(zip(w, w[1:]))
    data = np.frombuffer(texts[0].encode(), np.uint8)
    tok, pair, _ = language_model._tokens(data, np.array([0, len(data)]))
    w = texts[0].split()
    got = m.pair_counts(pair)
    for k in range(1, len(w)):
        true = pairs[w[k - 1], w[k]]
        assert true / 1.5 - 1 <= got[k] <= true * 1.5 + 1
        assert got[k] >= 1
    assert m.word_counts(tok).tolist() == [sum(t.split().count(x) for t in texts) for x in w] + [30]


def test_model_does_not_pass_through_the_driver(spark, monkeypatch):
    def refuse(*more, **named):
        raise AssertionError("the driver is sent the model")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", refuse)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(30)]
    one, more = (language_model.train(frame(spark, texts), **x) for x in ({}, {"part_bytes": 500}))
    assert len(one.words) == len(one.filters) == 1 and len(more.words) > 2 and len(more.filters) > 2
    tok, pair, _ = language_model._tokens(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    one, more = one.get(), more.get()
    assert Counter(dict(zip(tok.tolist(), more.word_counts(tok).tolist()))) == Counter(tok.tolist())
    assert (one.n, one.v) == (more.n, more.v) == (len(tok), len(set(tok.tolist())))
    assert more.pair_counts(pair).tolist() == one.pair_counts(pair).tolist() and more.pair_counts(pair).min() >= 1


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_score_against_exact_pair_counts(spark, bound):
    """Few counts, each the least of its level, so the filter's answers are the exact ones but for false positives."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(40)] + ["w1 w2 w3"] * 3 + [None, ""]
    docs = frame(spark, texts)
    held = language_model.train(docs, broadcast_bytes=bound)
    lam = held.lambdas = language_model.fit_lambdas(docs, held, "text")
    assert lam.max() > 0
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs, docs, broadcast_bytes=bound).collect()}
    seqs = [[None, *(t or "").split(), None] for t in texts]
    words = Counter(w for q in seqs for w in q[1:])
    pairs = Counter(p for q in seqs for p in zip(q, q[1:]))
    n, v = sum(words.values()), len(words)
    assert max(c for p, c in pairs.items()) <= 4
    close = 0
    for i, q in enumerate(seqs):
        want = 0.0
        for h, w in zip(q, q[1:]):
            k = lam[min(int(math.log2(words[h])), language_model.CLASSES - 1)]
            want += math.log10(k * pairs[h, w] / words[h] + (1 - k) * (words[w] + 1) / (n + v + 1))
        close += got[i] == pytest.approx(want, rel=1e-9)
    assert close >= 0.6 * len(seqs)  # a false positive in 30 probes changes a text's score a little


# ---------------------------------------------------------------- 8


def test_pfair_deviation(spark):
    rng = random.Random(9)
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    rows = [(i, words(rng, rng.randrange(1, 9)) if i % 50 else None, rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot string")
    out = mixing.mix(docs, weights=weights, block_bytes=256, period=100).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    src = lambda s: s if isinstance(s, str) else None
    order = {int(r.slot): src(r.source) for r in out.itertuples()}
    blocks = defaultdict(set)
    for r in out.itertuples():
        blocks[src(r.source)].add(int(r.block))
    assert len({(int(r.slot)) for r in out.itertuples()}) == sum(map(len, blocks.values()))
    first_end = min(max(t for t, s in order.items() if s == k) for k in weights)
    done = Counter()
    for t in range(first_end + 1):
        if t in order:
            done[order[t]] += 1
        if all(x in order for x in range(t + 1)):
            assert all(abs(done[s] - w * (t + 1)) < 1 for s, w in weights.items())
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, period=3).count()
    assert sorted(r["doc_id"] for r in mixing.mixed(docs).collect()) == list(range(3000))


def test_pfair_deviation_from_the_returned_weight(spark):
    rows = [(i, "x" * 64, ["a", "b", "c", "tiny"][0 if i < 19000 else 1 if i < 29000 else 2 if i < 29900 else 3]) for i in range(30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, weights={"a": 2.0, "b": 1.0 + 1 / 7, "c": 0.0917, "tiny": 0.0004}, block_bytes=64).toPandas().sort_values("slot")
    assert out.slot.tolist() == list(range(30000))
    end = min(out[out.source == s].slot.max() for s in ("a", "b", "c", "tiny"))
    assert end > 20000
    for s, g in out.groupby("source"):
        done = np.cumsum((out.source == s).to_numpy()[: end + 1])
        assert np.abs(done - g.weight.iloc[0] * np.arange(1, end + 2)).max() < 1, s
    many = spark.createDataFrame([(i, "x", f"s{i}") for i in range(1100)], "doc_id bigint, text string, source string")
    assert mixing.mix(many).select("slot").distinct().count() == 1100


def test_one_period_meets_its_windows():
    for parts in ({"a": 37, "b": 1, "c": 62}, {"a": 1, "b": 1}, {"x": 100}, {str(i): 1 for i in range(64)}):
        period = sum(parts.values())
        seen = Counter()
        for t, s in enumerate(mixing.one_period(parts, period)):
            seen[s] += 1
            assert (seen[s] - 1) * period // parts[s] <= t < -(-seen[s] * period // parts[s])
        assert seen == parts
    assert sum(mixing.shares({"a": 1e-9, "b": 1, "c": 3}, 16).values()) == 16


# ---------------------------------------------------------------- 9


def fingerprint(t, width, seed=42):
    w = SPACED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, distance):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_components(spark):
    rng = random.Random(10)
    texts = [*ODD, *[words(rng, rng.randrange(1, 200)) for _ in range(60)]]
    for _ in range(60):
        w = rng.choice(texts[10:60]).split()
        w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [texts[20]] * 10
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts, ", fp int", (1,)), width=3, distance=2).collect()}
    fps = [fingerprint(t, 3) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == roots(fps, 2)
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


TWO, THREE = [list(range(32)), list(range(32, 64))], [list(range(12)), list(range(12, 34)), list(range(34, 64))]


@pytest.mark.parametrize("bucket,grouping", [(512, None), (1, (THREE, [0, 0, 0])), (512, (TWO, [1, 0])), (1, (TWO, [1, 0]))])
def test_links_connect_all_near_pairs(spark, bucket, grouping):
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(8)}
    for v in list(values):
        for _ in range(3):
            values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    values = sorted(values, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = simhash.links(fps, 2, bucket, grouping)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 and a < b for a, b in got.collect())
    root = dict(map(tuple, simhash.components(got).collect()))
    assert [root.get(x, x) for x in signed] == [signed[i] for i in roots(values, 2)]


def test_allocation_is_a_pigeonhole():
    for m in (1, 2, 3, 5):
        cost = [[0.0, 5.0 * i + 1, 30.0, 90.0] for i in range(m)]
        total, ts = simhash.allocate(cost, 2)
        assert sum(t + 1 for t in ts) == 3 and min(ts) >= -1 and total == pytest.approx(sum(c[t + 1] for c, t in zip(cost, ts, strict=True)))


def test_deduplicate(spark):
    rng = random.Random(12)
    base = [words(rng, 200, 9999) for _ in range(20)]
    texts = [*base, *[b.replace(" ", "  ", 1) for b in base[:5]], base[0], base[0], None, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (None, base[4]), (None, "all alone here")]
    kept = Counter(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == Counter([*range(20), 27, None])


def test_deduplicate_at_similarity(spark):
    rng = random.Random(14)
    texts = [words(rng, rng.randrange(20, 120), 9999) for _ in range(40)]
    for _ in range(160):  # near copies on both sides of 0.8, also of near copies, all with one passage
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        texts.append(" ".join(w + ["the", "same", "six", "words", "at", "end"] * rng.randrange(2)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts for w in [t.split()]]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and up[i] != up[j]:
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    assert 45 < len(set(up)) < 195
    assert sorted(r["doc_id"] for r in simhash.deduplicate(frame(spark, texts)).collect()) == sorted(set(up))


def test_deduplicate_links_fingerprints_first(spark, monkeypatch):
    rng = random.Random(15)
    texts = [words(rng, 300, 9999) for _ in range(12)]
    texts += [" ".join([*t.split()[:-1], "end"]) for t in texts]
    fps = [fingerprint(t, 5) for t in texts]
    near = sum((fps[i] ^ fps[i + 12]).bit_count() <= 2 for i in range(12))
    given, compared, links, verified = [], [], simhash.links, simhash._verified

    def linked(values, *more):
        given.append({r["fp"] % (1 << 64) for r in values.collect()})
        return links(values, *more)

    def checked(pairs, *more):
        out = verified(pairs, *more)
        compared.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "links", linked)
    monkeypatch.setattr(simhash, "_verified", checked)
    assert {r["doc_id"] for r in simhash.deduplicate(frame(spark, texts)).collect()} == set(range(12))
    assert given == [set(fps)]
    # what fingerprints link is compared first, and the rest only then
    assert 0 < near < 12 and compared == [(near, near), (12 - near, 12 - near), (0, 0)]


def test_links_start_no_python_workers(spark):
    """Rows from Python, even none, need a family of workers of their own in each executor."""
    assert "LogicalRDD" not in simhash.links(spark.range(9).withColumnRenamed("id", "fp"), 2)._jdf.queryExecution().analyzed().toString()


def test_links_plan_hot_values_only_where_there_are_any(spark, monkeypatch):
    planned, hot_links = [], simhash._hot_links
    monkeypatch.setattr(simhash, "_hot_links", lambda *a: planned.append(a) or hot_links(*a))
    fps = spark.range(40).withColumnRenamed("id", "fp")
    grouping = ([list(range(32)), list(range(32, 64))], [1, 0])  # all agree in the second part
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if (a ^ b).bit_count() <= 2}
    assert set(map(tuple, simhash.links(fps, 2, 64, grouping).collect())) == want and not planned
    assert set(map(tuple, simhash.links(fps, 2, 16, grouping).collect())) <= want and len(planned) == 1


def test_deduplicate_workers_hold_little(spark, monkeypatch):
    rng = random.Random(16)
    docs, mapped, batches = frame(spark, [words(rng, 300) for _ in range(40)]), {}, []
    key, plain, stage = "spark.sql.execution.arrow.maxBytesPerBatch", type(docs).mapInArrow, simhash.staged

    def noted(self, f, schema):
        mapped[schema.split(",")[0]] = f
        return plain(self, f, schema)

    def staged(df, name):
        batches.append(spark.conf.get(key))
        return stage(df, name)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    monkeypatch.setattr(simhash, "staged", staged)
    before = spark.conf.get(key, None)
    assert simhash.deduplicate(docs).count() == 40
    assert set(batches) == {str(1 << 20)} and spark.conf.get(key, None) == before

    def peak(work, rows):
        tracemalloc.start()
        got = sum(b.num_rows for b in work(iter(rows)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got
        return most

    texts = pa.array([words(rng, 300, 99_999) for _ in range(1500)], pa.string())  # 3 MB
    n = pa.array(range(len(texts)), pa.int64())
    assert peak(mapped["`doc_id` bigint"], [pa.RecordBatch.from_pydict({"doc_id": n, "text": texts, "__tw_0": n, "__tw_1": n})]) < 40 << 20
    one = pa.binary()
    slices = [pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "t": pa.array([0], pa.int32()), "k": pa.array([simhash.pack_keys(np.array([p << 18], np.uint64))], one), "n": pa.array([simhash.pack(np.ones(1, np.uint32))], one)}) for p in range(64)]
    assert peak(mapped["p int"], slices) < 16 << 20  # all slices of the counts in one task


# ---------------------------------------------------------------- 10


def test_neighbour_votes(spark):
    rng = random.Random(13)
    good, bad = lambda: words(rng, 60), lambda: " | ".join(words(rng, 2).upper() for _ in range(30))
    texts = [good() if i % 2 else bad() for i in range(120)]
    docs = frame(spark, texts, ", score string", ("s",))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(0, 0), (None, 1), (500, None)], "doc_id bigint, quality int")
    model = quality_knn.fit(docs, labels, sample=60)
    assert len(model["labels"]) <= 60
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, model).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(80, 120)) and all(0 <= s <= 1 for s in got.values())
    odd = {r["doc_id"]: r["score"] for r in quality_knn.score(frame(spark, ODD), model).collect()}
    assert odd[0] == odd[1] == pytest.approx(model["prior"])
    assert quality_knn.score(docs, quality_knn.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    raw = np.frombuffer(texts[0].encode(), np.uint8)
    z = quality_knn.vote(model, raw, np.array([0, len(raw)]), 15, 8.0)
    assert z[0] == pytest.approx(got[0])


