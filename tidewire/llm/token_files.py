"""Token ids as flat unsigned integer files with 64-bit document offsets.

The documents are dealt by ranges of their id, so that the partitions in order are the documents in
order. A task writes its ids end to end (16 bits each while the vocabulary fits, else 32), the ids of
its documents and their lengths; the driver adds up the parts' totals (one row a part), and a second
pass writes each part's offsets from its base, as unsigned 64-bit integers over the whole corpus.
Files get their names only when complete, so a task that is run again just replaces its own.

Readers map the files into memory; a store that can't be mapped is read instead.

Defined cases: a null text is empty (only the end id); null document ids come first; documents of
one id follow in the order of a hash of the text; an empty table gives no parts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beyond so many remembered words (or pieces) a worker forgets them all.
MEMO = 1_000_000


def _byte_letters() -> list[str]:
    """The printable character that byte-level models write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """Encodes texts with the tokenizers library, remembering words.

    Where the tokenizer lower-cases, folds white space and never lets a piece reach over it, a
    text's ids are those of its words; the library's model is asked once for each piece of a word.
    All else (other tokenizers, special tokens, letters beyond Latin, odd white space) goes through
    the library's whole encoding.
    """

    def __init__(self, spec: str, dtype: str):
        from tokenizers import Tokenizer

        self.whole, self.dtype, self.code = Tokenizer.from_str(spec), dtype, "H" if dtype == "<u2" else "I"
        self.tokenize = self.whole.model.tokenize
        d = json.loads(spec)
        steps = [(x.get("type"), x.get("pattern", {}).get("Regex"), x.get("content")) for x in (d.get("normalizer") or {}).get("normalizers", [])]
        split = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_word = steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        by_word = by_word and split[0].get("behavior") == "Removed" and split[0].get("invert") and not split[1].get("add_prefix_space") and not split[1].get("use_regex") and r"\s" in split[0]["pattern"]["Regex"] and d.get("post_processor") is None
        self.pieces = regex.compile(split[0]["pattern"]["Regex"]) if by_word else None
        self.plain = regex.compile(r"[!-;=-~À-įı-ɏ]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.letters = _byte_letters()
        self.words, self.known = _Memo(self._word), _Memo(self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and word.isascii():
            return self.known[word] if word in self.known else self._piece(word)
        if not self.plain.fullmatch(word):
            return self._whole(word)
        return b"".join(map(self.known.__getitem__, self.pieces.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        if self.pieces is None or self.odd.search(text):
            return self._whole(text)
        for memo in (self.words, self.known):
            if len(memo) > MEMO:
                memo.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        v = self[key] = self.make(key)
        return v


#: A worker's encoders, by the text of the tokenizer file; they keep their words from task to task.
_encoders: dict[str, Encoder] = {}


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file:" + path.removeprefix("file:"))


class _File:
    """An output file that gets its name when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.tmp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)


def _array(path: str, dtype: str) -> np.ndarray:
    fs, p = _fs(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(p, dtype, "r") if fs.get_file_info(p).size else np.zeros(0, dtype)
    with fs.open_input_file(p) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, tokenizer_json: str, out_dir: str, end_id: int | None = None, parts: int | None = None, text: str = "text", row_id: str = "doc_id") -> list[dict]:
    """Write ``docs`` as token files into ``out_dir`` (a folder that all executors share); returns the parts of the manifest."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spec = open(tokenizer_json, encoding="utf-8").read()
    size = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(size, (end_id or 0) + 1) <= 1 << 16 else "<u4"
    held = spark.sparkContext.broadcast(spec)  # one tokenizer file, of a few megabytes
    fs, top = _fs(out_dir)
    fs.create_dir(top, recursive=True)
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    width = int(dtype[-1])

    def write(batches):
        name = f"{out_dir}/part-{TaskContext.get().partitionId():05d}"
        enc = _encoders.get(held.value) or _encoders.setdefault(held.value, Encoder(held.value, dtype))
        ids, lengths, n = [], [], 0
        first = next(iter_ := (b for b in batches if b.num_rows), None)
        if first is None:
            return
        with _File(f"{name}.ids") as out:
            for b in (x for g in ((first,), iter_) for x in g):
                for t in b.column("t"):
                    got = enc.encode(t.as_py() or "") + end
                    out.write(got)
                    lengths.append(len(got) // width)
                ids.append(b.column("id"))
        n = len(lengths)
        with _File(f"{name}.len") as out:
            out.write(np.array(lengths, "<u8").tobytes())
        with _File(f"{name}.doc") as out, pa.ipc.new_file(out, pa.schema([("id", ids[0].type)])) as w:
            for x in ids:
                w.write_batch(pa.RecordBatch.from_arrays([x], names=["id"]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "docs": pa.array([n], pa.int64()), "tokens": pa.array([sum(lengths)], pa.int64())})

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(row_id).alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = keyed.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "t")
    made = sorted(dealt.mapInArrow(write, "part int, docs bigint, tokens bigint").collect())
    manifest, docs_before, tokens_before = [], 0, 0
    for part, n, tokens in made:
        manifest.append({"part": part, "docs": n, "tokens": tokens, "first_doc": docs_before, "base": tokens_before})
        docs_before, tokens_before = docs_before + n, tokens_before + tokens

    def offsets(batches):
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                name = f"{out_dir}/part-{part:05d}"
                with _File(f"{name}.idx") as out:
                    out.write(np.concatenate([[base], base + np.cumsum(_array(f"{name}.len", "<u8"))]).astype("<u8").tobytes())
            yield b

    if manifest:
        rows = spark.createDataFrame([(m["part"], m["base"]) for m in manifest], "part int, base bigint").repartition(len(manifest))
        rows.mapInArrow(offsets, "part int, base bigint").count()
    with _File(f"{out_dir}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "parts": manifest, "id_type": docs.schema[row_id].dataType.simpleString()}).encode())
    return manifest


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files."""
    fs, top = _fs(out_dir)
    with fs.open_input_file(f"{top}/manifest.json") as f:
        spec = json.loads(f.read())
    dtype = spec["dtype"]
    schema = f"doc_id {spec['id_type']}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def read(batches):
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                name = f"{out_dir}/part-{part:05d}"
                ids, at = _array(f"{name}.ids", dtype), _array(f"{name}.idx", "<u8").astype(np.int64)
                f, p = _fs(f"{name}.doc")
                with f.open_input_file(p) as file:
                    doc = pa.ipc.open_file(file).read_all().column("id").combine_chunks()
                for lo in range(0, len(doc), 4096):
                    cuts = at[lo : lo + 4097] - base
                    each = [ids[x:y].astype("<u4") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    cols = {"doc_id": doc[lo : lo + 4096], "start": pa.array(at[lo : lo + len(each)]), "n_tokens": pa.array(np.diff(cuts)), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    rows = spark.createDataFrame([(m["part"], m["base"]) for m in spec["parts"]], "part int, base bigint")
    return rows.repartition(max(1, len(spec["parts"]))).mapInArrow(read, schema)
