"""Token ids in Arrow's file format: record batches of equal-length sequences and their masks.

Each range of doc_id is a file. A row is a sequence: ``ids`` and ``mask`` (is there a token) and ``ends`` (is it the
last of its document) are fixed-size lists, so sequence i of a batch lies at i * length in one buffer, and a mapped
file is read in place. ``docs`` lists the documents that end in the row.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._ranges import id_key, id_ranges
from ._store import Scratch, file_system, replace

LENGTH = 2048
#: sequences in a record batch
ROWS = 512
END = 2
#: pieces that a worker remembers before it forgets all
REMEMBERED = 1_800_000

_LETTERS_SIGNS = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}]+)")
_ONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """The tokenizers library, asked once for every piece of text between two single spaces.

    Where the file's pattern begins a token at each such space, a text's ids are its pieces' ids one after another;
    with any other file the library is asked for whole texts. A worker remembers up to REMEMBERED pieces, some 400 MB.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        #: does the file's pattern begin a token at each single space, and is nothing else done to the text?
        self.by_pieces = (
            spec["normalizer"] is None and spec["post_processor"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.later: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.odd = {""}
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])

    def _ask(self, texts: list[str]) -> list[bytes]:
        code = self.kind.char
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each behind a space: many go in one text and part where a token has the space."""
        texts = [" " + " ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        flat = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        at = [*np.flatnonzero(self.spaced[flat]).tolist(), len(flat)]
        data, width = flat.tobytes(), self.kind.itemsize
        return [data[width * a : width * b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces behind a space. Letters and the signs behind them are apart in the pattern."""
        later, cut, ask, words = self.later, [], [], set()
        for p in pieces:
            if p.isalpha():
                words.add(p)
            elif m := _LETTERS_SIGNS.fullmatch(p):
                a, b = m.groups()
                cut.append((p, a, b))
                if a not in later:
                    words.add(a)
            else:
                ask.append(p)
                if not p or p[0].isspace() or p[-1].isspace():
                    self.odd.add(p)
        if words:
            listed = list(words)
            later.update(zip(listed, self._words(listed), strict=True))
        later.update(zip(ask, self._ask([" " + p for p in ask]), strict=True))
        signs = list({b for _, _, b in cut}.difference(self.signs))
        self.signs.update(zip(signs, self._ask(signs), strict=True))
        later.update((p, later[a] + self.signs[b]) for p, a, b in cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids, one after another as integers of ``kind``."""
        if not self.by_pieces:
            return self._ask(texts)
        if len(self.later) > REMEMBERED:
            self.later, self.signs, self.odd = {}, {}, {""}
        split = [t.split(" ") for t in texts]
        rest = [s[1:] for s in split]
        later = self.later
        self._learn(set().union(*rest).difference(later))
        # white space of more than one sign is a token that may reach over a space
        wide = [k for k, s in enumerate(split) if s[0][-1:].isspace() or not s[0] or not self.odd.isdisjoint(s)]
        for k in wide:
            split[k] = _ONE_SPACE.split(texts[k])
            rest[k] = split[k][1:]
        if wide:
            self._learn(set().union(*(rest[k] for k in wide)).difference(later))
        first = self._ask([s[0] for s in split])
        return [a + b"".join([later[p] for p in r]) for a, r in zip(first, rest, strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("ends", pa.list_(pa.bool_(), length)),
            ("docs", pa.list_(pa.int64())),
        ]
    )


class _File:
    """One file in the making: whole sequences leave in record batches, the last one is filled up at the end."""

    def __init__(self, uri: str, length: int, kind: np.dtype):
        self.uri, self.length, self.kind, self.schema = uri, length, kind, schema(length, kind)
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.end_at: list[int] = []  # among the waiting ids
        self.end_of: list[int | None] = []
        self.held = self.tokens = self.docs = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        own = np.frombuffer(ids, self.kind)
        self.waiting += [own, np.array([END], self.kind)]
        self.held += len(own) + 1
        self.tokens += len(own) + 1
        self.docs += 1
        self.end_at.append(self.held - 1)
        self.end_of.append(doc)
        if self.held >= self.length * ROWS:
            self._write(self.held // self.length * self.length)

    def _write(self, n: int) -> None:
        """Write the first n waiting ids, n being whole sequences, or more than are there to fill the last one up."""
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        real, rest = flat[:n], flat[n:]
        ids, mask, ends = np.zeros(n, self.kind), np.zeros(n, bool), np.zeros(n, bool)
        ids[: len(real)], mask[: len(real)] = real, True
        here = [x for x in self.end_at if x < n]
        ends[here] = True
        per_row = np.bincount(np.array(here, np.int64) // self.length, minlength=n // self.length)
        docs = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(self.end_of[: len(here)], pa.int64())
        )
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, ends)]
        whole = pa.RecordBatch.from_arrays([*fixed, docs], schema=self.schema)
        for i in range(0, whole.num_rows, ROWS):
            self.writer.write_batch(whole.slice(i, ROWS))
        self.waiting, self.held = ([rest] if len(rest) else []), len(rest)
        self.end_at, self.end_of = [x - n for x in self.end_at[len(here) :]], self.end_of[len(here) :]

    def close(self) -> tuple[str, int, int]:
        if self.held:
            self._write(-(-self.held // self.length) * self.length)
        self.writer.close()
        self.out.close()
        replace(self.fs, self.part, self.path)
        return self.uri, self.tokens, self.docs


def write_tokens(docs: DataFrame, scratch: Scratch, path: str | None = None, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> list[tuple[str, int, int]]:
    """Write every text's ids and an end id, in ascending doc_id; returns (file, tokens, documents) in that order.

    A null text is empty and has the end id alone. A null doc_id comes first; rows of one doc_id are in the order
    of a hash of their texts. A task that runs again writes the same file.
    """
    path, folder = path or default_path(), scratch.path("tokens")
    ranges = id_ranges(docs, doc_id)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), ranges.pick(id_key(doc_id)).alias("p")
    )
    dealt = rows.repartitionById(ranges.n, F.col("p")).sortWithinPartitions("p", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, at = encoder(path), None, None
        done = []
        for b in batches:
            for i in range(0, b.num_rows, 500):
                ids, texts, ps = (c.to_pylist() for c in b.slice(i, 500).columns)
                for doc, p, found in zip(ids, ps, own.encode(texts), strict=True):
                    if p != at:
                        if out:
                            done.append((at, *out.close()))
                        out, at = _File(f"{folder}/{p:06d}.arrow", length, own.kind), p
                    out.add(doc, found)
        if out:
            done.append((at, *out.close()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["p", "file", "tokens", "docs"],
        )

    files = scratch.keep(dealt.mapInArrow(write, "p int, file string, tokens long, docs long"), "files")
    return [(r["file"], r["tokens"], r["docs"]) for r in sorted(files.collect())]  # a row a file


def sequences(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """A file's record batches as (ids, mask, ends, docs): matrices of a row a sequence, in place where mapped."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            b = reader.get_batch(k)
            length = b.schema.field("ids").type.list_size
            yield (
                *(b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, length) for c in ("ids", "mask", "ends")),
                b.column("docs").to_pylist(),
            )


def sequence(local: str, i: int) -> np.ndarray:
    """Sequence i of a local file, a view on the mapped file."""
    with pa.memory_map(local) as f:
        reader = pa.ipc.open_file(f)
        return reader.get_batch(i // ROWS).column("ids")[i % ROWS].values.to_numpy()


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; a task a file."""
    bases, total = [], 0
    for k, (file, tokens, _) in enumerate(files):
        bases.append((k, file, total))
        total += tokens
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                crc, n, start = 0, 0, base
                for ids, mask, ends, docs in sequences(file):
                    flat, last = ids[mask], np.flatnonzero(ends[mask])
                    rows, a = [], 0
                    for doc, z in zip([d for ds in docs for d in ds], last.tolist(), strict=True):
                        crc, n = zlib.crc32(flat[a : z + 1].astype("<u4").tobytes(), crc), n + z + 1 - a
                        rows.append((doc, start, n, crc))
                        crc, n, start, a = 0, 0, start + n, z + 1
                    crc, n = zlib.crc32(flat[a:].astype("<u4").tobytes(), crc), n + len(flat) - a
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)

    listed = spark.createDataFrame(bases, "k int, file string, base long").repartitionById(max(1, len(bases)), F.col("k"))
    return listed.select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
