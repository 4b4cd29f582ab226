"""Language identification of mixed-language text.

A word's first letter names its script, by ranges of code points, and the script narrows the
languages to those that write a share of their words in it. The candidates are scored by hashed
character n-grams (2 to 4 bytes with the word's edges), and a Viterbi pass over the words with a
penalty for each switch labels spans. A text's language is the one whose spans hold most of it; the
score is that share.

The model is a table of fixed size, fitted on at most about ``docs_per_lang`` labelled documents of
each language, drawn by a hash.

A worker's memory does not follow the size of its Arrow batches: n-grams are made for ``PIECE`` bytes
at a time, within a long text or word too, and Viterbi runs over rows side by side until the tables of
their words fill ``ROOM``. The words of one text are held together, however many they are.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing could be learnt; words in a script of no learnt language are neutral, and a text of them
alone gets the commonest language with score 0; repeated rows are alike; an input column named like
a computed one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import U64, blocks, fresh, prefix_hash, span_hash, word_spans

OUT = ("lang_pred", "score", "spans")
SLOTS = 1 << 16
SIZES = (2, 3, 4)
PIECE = 1 << 18
ROOM = 64 << 20

# First code point of each script range, in order (Unicode blocks).
RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in RANGES])

#: Word bytes of lower-cased text: letters, and all beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def _lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)], dtype=np.int64)


def _scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of the code point that begins at each start."""
    at = np.minimum(starts[:, None] + np.arange(4), len(data) - 1)
    b = data[at].astype(np.int64)
    low = b[:, 1:] & 0x3F
    cp = np.where(b[:, 0] < 0x80, b[:, 0], np.where(b[:, 0] < 0xE0, (b[:, 0] & 0x1F) << 6 | low[:, 0], np.where(b[:, 0] < 0xF0, (b[:, 0] & 0x0F) << 12 | low[:, 0] << 6 | low[:, 1], 0x20000)))
    return _SCRIPT[np.maximum(np.searchsorted(_STARTS, cp, "right") - 1, 0)]


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words of at most ``PIECE`` bytes together, or of one word."""
    end, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + PIECE, "right")))
        yield at, to
        at = to


def _grams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slot and word of each n-gram of the words [s, e), edges as spaces, for ``PIECE`` bytes at a time."""
    size = e - s + 2
    last = np.cumsum(size)
    first, total = last - size, int(last[-1])
    for at in range(0, total, PIECE):
        to, end = min(at + PIECE, total), min(at + PIECE + SIZES[-1] - 1, total)  # n-grams that begin before ``to``
        word = np.repeat(np.arange(len(s)), np.clip(last, at, end) - np.clip(first, at, end))
        inner, left = np.arange(at, end) - first[word], size[word]
        left -= inner
        padded = np.full(end - at, 32, np.uint8)
        keep = (inner > 0) & (left > 1)
        padded[keep] = data[(s[word] + inner - 1)[keep]]
        prefix, slots, owner = prefix_hash(padded), [], []
        for n in SIZES:
            here = np.flatnonzero(left[: to - at] >= n)
            slots.append((span_hash(prefix, here, here + n) & U64(SLOTS - 1)).astype(np.int64))
            owner.append(word[here])
        yield np.concatenate(slots), np.concatenate(owner)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", row_id: str = "doc_id", docs_per_lang: int = 1500) -> dict:
    """{langs, logp (slots x langs), candidates (scripts x langs)}, fitted on a bounded sample of ``docs``."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(6), F.col(row_id).cast("string"), F.col(text)).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    bound = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, docs_per_lang / counts[k]) * (1 << 20)))]), F.col("lang"))
    sample = known.where(F.pmod("h", F.lit(1 << 20)) < bound)

    def count(batches):
        slot_n, script_n = np.zeros((len(langs), SLOTS), np.int64), np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for batch, _, _ in blocks(batches, "text", PIECE):
            of = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            data, offs = _lowered(batch.column("text").to_pylist())
            s, e, row = word_spans(data, offs, _LETTERS)
            for x, y in _runs(e - s + 2):
                for slots, owner in _grams(data, s[x:y], e[x:y]):
                    np.add.at(slot_n, (of[row[x:y][owner]], slots), 1)
                np.add.at(script_n, (of[row[x:y]], _scripts(data, s[x:y])), 1)
        both = np.concatenate([slot_n, script_n], axis=1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": both[i, j]})

    both = np.zeros((len(langs), SLOTS + len(SCRIPTS)))
    got = sample.select("lang", "text").mapInArrow(count, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    both[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("n").to_numpy()
    slots, scripts = both[:, :SLOTS], both[:, SLOTS:]
    logp = np.log((slots + 0.5) / (slots.sum(axis=1, keepdims=True) + 0.5 * SLOTS)).T.astype(np.float32)
    candidates = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= 0.005).T
    return {"langs": langs, "logp": np.ascontiguousarray(logp), "candidates": candidates, "common": int(np.argmax([counts[k] for k in langs]))}


def word_scores(model: dict, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log posterior of each language for each word, its bytes and its row."""
    s, e, row = word_spans(data, offs, _LETTERS)
    k = len(model["langs"])
    out = np.zeros((len(s), k), np.float32)
    for x, y in _runs(e - s + 2):
        total, of = np.zeros((y - x, k)), np.zeros(y - x, np.int64)
        for slots, owner in _grams(data, s[x:y], e[x:y]):
            of += np.bincount(owner, minlength=y - x)
            for j in range(k):
                total[:, j] += np.bincount(owner, model["logp"][slots, j], y - x)
        own = (total / np.maximum(of, 1)[:, None] * (e - s + 1)[x:y, None]).astype(np.float32)
        may = model["candidates"][_scripts(data, s[x:y])]
        own = np.where(may, own, -np.inf)
        own[~may.any(axis=1)] = 0
        own -= own.max(axis=1, keepdims=True)
        out[x:y] = np.maximum(own, -12)
    return out, e - s, row


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: the sum of its scores less ``penalty`` for each switch; all documents side by side."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n, k = scores.shape
    came = np.empty((n, k), np.uint8 if k < 256 else np.uint16)
    label = np.zeros(n, came.dtype)
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # documents longer than t
    v = np.zeros((len(first), k), np.float32)
    own = np.arange(k)
    for t in range(longest):
        a = int(active[t])
        w, at = v[:a], first[:a] + t
        if t:
            best = w.argmax(axis=1)
            top = w[np.arange(a), best][:, None] - np.float32(penalty)
            stay = w >= top
            came[at] = np.where(stay, own, best[:, None])
            v[:a] = np.where(stay, w, top) + scores[at]
        else:
            v[:a] = scores[at]
    last = np.zeros(len(first), np.int64)
    for t in range(longest - 1, -1, -1):
        a = int(active[t])
        at = first[:a] + t
        ends = length[:a] == t + 1
        last[:a] = np.where(ends, v[:a].argmax(axis=1), last[:a])
        label[at] = last[:a]
        if t:
            last[:a] = came[at, last[:a]]
    return label


def identify(docs: DataFrame, model: dict, text: str = "text", penalty: float = 6.0, with_spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and spans (runs of words: first word, words, language)."""
    docs = fresh(docs, *OUT)
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages floats
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def added(batch, pred, score, spans):
        cols = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)]
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *OUT])

    def read(part, m):
        """Scores and weight of each word; words of each row, and whether it has a letter."""
        texts = pc.fill_null(part.column(text), "").to_pylist()
        scores, size, row = word_scores(m, *_lowered(texts))
        sure = (scores.min(axis=1) < 0) | (len(m["langs"]) == 1)
        length = np.bincount(row, minlength=len(texts))
        # beyond ASCII a word may be of marks or digits alone
        lettered = np.array([bool(c) and any(map(str.isalpha, t)) for c, t in zip(length, texts, strict=True)], bool)
        return scores, np.where(sure, size, 0).astype(np.int32), length, lettered

    def settled(batch, parts, m):
        scores, size, length, lettered = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        langs, k, n = m["langs"], len(m["langs"]), batch.num_rows
        first = np.cumsum(length) - length
        full = np.flatnonzero(length)
        label = viterbi(scores, first[full], length[full], penalty)
        row = np.repeat(np.arange(n), length)
        weight = np.bincount(row * k + label, size, n * k).reshape(n, k)
        total = weight.sum(axis=1)
        best = np.where(total > 0, weight.argmax(axis=1), m["common"])
        score = np.where(lettered & (total > 0), weight.max(axis=1) / np.maximum(total, 1), 0.0)
        spans = [[] for _ in range(n)]
        cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (row[1:] != row[:-1])]) if with_spans and len(label) else []
        for x, y in zip(cut, [*cut[1:], len(label)], strict=True) if len(cut) else []:
            spans[row[x]].append({"first": int(x - first[row[x]]), "words": int(y - x), "lang": langs[label[x]]})
        return added(batch, [langs[b] if has else "und" for b, has in zip(best, lettered, strict=True)], score, spans)

    def work(batches):
        m = held.value
        k = len(m["langs"])
        for batch in batches:
            if not k:
                yield added(batch, ["und"] * batch.num_rows, np.zeros(batch.num_rows), [[]] * batch.num_rows)
                continue
            at, to, words, parts = 0, 0, 0, []
            for part, _, _ in blocks(iter([batch]), text, PIECE):
                parts.append(read(part, m))
                to, words = to + part.num_rows, words + len(parts[-1][1])
                if words * (8 * k + 24) >= ROOM or to == batch.num_rows:
                    yield settled(batch.slice(at, to - at), parts, m)
                    at, words = to, 0

    return docs.mapInArrow(work, f"{schema}, lang_pred string, score double, spans array<struct<first: bigint, words: bigint, lang: string>>")
