"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the pairs of neighbours by binary search among
the sorted pair keys of the merge table, finds each word's lowest rank, merges that pair wherever it stands in the
word, and drops the words in which nothing merges any more.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pieces that a worker remembers before it forgets all
REMEMBERED = 150_000
TEXTS_A_BATCH = 1000
#: words in one flat array
WORDS_A_BATCH = 50_000
_NONE = np.int64(1 << 60)
#: white space of the files' patterns; Python's own has four control characters more
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


_CONTROL = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A byte-pair vocabulary whose words end in a suffix, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"]:
            raise ValueError(f"{path}: only files that compose, lower-case and take words by a pattern are handled")
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE[1:-1]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order].astype(self._key_type()), order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.shown = [t.encode() for t in self.token]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.forget()

    def _key_type(self) -> type:
        return np.uint32 if self.size**2 < 1 << 32 else np.uint64

    def forget(self) -> None:
        self.words.clear()
        self.known.clear()
        # a special token stands behind a space, which no piece has
        self.known.update((" " + t, np.uint32(i).astype("<u4").tobytes()) for t, i in self.special.items())

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (none of them empty) in one array, and each word's bounds in it."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.inner[data]
        ids[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids) > 1:
            key = (ids[:-1] * self.size + ids[1:]).astype(self.keys.dtype)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.flatnonzero((self.keys[at] == key) & (word[1:] == word[:-1]))
            rank = np.full(len(ids), _NONE)
            rank[found] = self.ranks[at[found]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            rest = lowest < _NONE
            done.append((word[~rest], ids[~rest]))
            hit = (rank == lowest) & rest
            # of pairs that overlap, as in "aaa", every second one merges
            turn = np.flatnonzero(hit)
            if len(turn):
                begins = np.concatenate([[True], np.diff(turn) > 1])
                start = np.maximum.accumulate(np.where(begins, np.arange(len(turn)), 0))
                turn = turn[(np.arange(len(turn)) - start) % 2 == 0]
                ids[turn] = self.merged[rank[turn]]
                rest[turn + 1] = False
            ids, word = ids[rest], word[rest]
        done.append((word, ids))
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces of text without white space."""
        split = {p: self.word.findall(p) for p in pieces}
        words = list(set().union(*split.values()).difference(self.words))
        for i in range(0, len(words), WORDS_A_BATCH):
            some = words[i : i + WORDS_A_BATCH]
            flat, at = self.merge_words([w.encode() for w in some])
            data, bounds = flat.astype("<u4").tobytes(), at.tolist()
            self.words.update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, bounds, bounds[1:], strict=False))
        known, word = self.known, self.words
        for p, ws in split.items():
            known[p] = word[ws[0]] if len(ws) == 1 else b"".join([word[w] for w in ws])

    def pieces(self, text: str) -> list[str]:
        """Pieces between white space, normalised; a special token has a space before it."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._plain(text[at : m.start()]), " " + m.group()]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character for itself: no final sigma
        text = text.lower()
        if _CONTROL.search(text):
            return [p for p in regex.split(_SPACE + "+", text) if p]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text: ids as little-endian 32-bit integers."""
        out = []
        for i in range(0, len(texts), TEXTS_A_BATCH):
            split = [self.pieces(t) for t in texts[i : i + TEXTS_A_BATCH]]
            if len(self.known) > REMEMBERED:
                self.forget()
            self.learn(set().union(*split).difference(self.known))
            known = self.known
            out += [b"".join([known[p] for p in ps]) for ps in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids as ``encode`` gives them, in UTF-8: tokens joined by spaces, as the file names no decoder."""
        shown = self.shown
        try:
            return b" ".join([shown[i] for i in np.frombuffer(ids, "<u4").tolist()])
        except IndexError:  # ids beyond the vocabulary stand for nothing
            return b" ".join([shown[i] for i in np.frombuffer(ids, "<u4").tolist() if i < self.size])


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and the ids themselves if asked.

    A null text is an empty one and has no tokens. Rows stay as they are: a repeated row is encoded again.
    """
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                found = bpe.encode([x or "" for x in part.column(1).to_pylist()])
                columns = [
                    part.column(0).cast(pa.int64()),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in found], pa.string()),
                ]
                if ids:
                    flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()  # the worker goes on to other stages
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, schema)
