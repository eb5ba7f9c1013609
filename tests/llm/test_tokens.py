import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import bpe, token_arrow

from . import cases

ALPHABET = st.sampled_from(
    [
        *"abcLS '.,!9\n\t\x0b\x1c\x85 ",
        "é",
        "É",
        "é",
        "Σ",
        "σ",
        "İ",
        "ß",
        "中",
        "🙂",
        "²",
        "Ⅷ",
        "<|endoftext|>",
        "<|startoftext|>",
        "<|",
        "'ll",
        "'RE",
    ]
)
TEXTS = st.lists(st.lists(ALPHABET, max_size=14).map("".join), max_size=6)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


WORD, BYTE = library(bpe.default_path()), library(token_arrow.default_path())


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_as_the_library(texts):
    own = bpe.load(bpe.default_path())
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = WORD.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids).decode() == WORD.decode(want, skip_special_tokens=False)
    encoder = token_arrow.encoder(token_arrow.default_path())
    assert encoder.by_pieces
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == BYTE.encode(text, add_special_tokens=False).ids


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TEXTS_A_BATCH", 2)
    own = bpe.WordBpe(bpe.default_path())
    texts = ["one two three", "four five", "one six", "", "aaaa" * 50]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [WORD.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_beyond_the_vocabulary():
    own = bpe.load(bpe.default_path())
    ids = own.encode(["two words"])[0]
    assert own.decode(ids + np.array([1 << 31], "<u4").tobytes()) == own.decode(ids) != b""


def test_another_file_is_asked_for_whole_texts():
    """A file whose pattern is not that of single spaces: the pieces are not taken apart."""
    own = token_arrow.Encoder(bpe.default_path())
    assert not own.by_pieces
    texts = ["One  two <|endoftext|>", "", " Three "]
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [WORD.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_documents(spark):
    docs = cases.documents(spark)
    want = []
    for r in docs.collect():
        ids = WORD.encode(r.text or "", add_special_tokens=False).ids
        want.append(
            (
                r.doc_id,
                len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
            )
        )
    got = bpe.encode_documents(docs, ids=True).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(cases.empty(spark)).count() == 0


def test_very_long_texts(spark):
    """A text of more than two million bytes goes the same way."""
    long = "Some words, 123 numbers; and Ünïcode! " * 60_000
    assert len(long) > 2 << 20
    docs = spark.createDataFrame([cases.row(1, long), cases.row(2, "x" * 30_000)], cases.SCHEMA)
    want = {r.doc_id: WORD.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(docs).collect()} == {
        i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in want.items()
    }
    files = token_arrow.write_tokens(docs, cases.scratch(spark))
    whole = {r.doc_id: np.array([*BYTE.encode(r.text, add_special_tokens=False).ids, token_arrow.END], "<u4") for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_arrow.read_tokens(spark, files).collect()} == {
        i: (len(x), zlib.crc32(x.tobytes())) for i, x in whole.items()
    }


def test_token_files(spark):
    docs = cases.documents(spark)
    scratch = cases.scratch(spark)
    files = token_arrow.write_tokens(docs, scratch, length=64)
    got = sorted((tuple(r) for r in token_arrow.read_tokens(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: -1 if i is None else i)
    by_id, at = {}, 0
    for r in docs.collect():
        ids = np.array([*BYTE.encode(r.text or "", add_special_tokens=False).ids, token_arrow.END], "<u4")
        by_id.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc, start, n, crc in got:
        assert start == at and (n, crc) in by_id[doc]
        by_id[doc].remove((n, crc))
        at += n
    assert not any(by_id.values())
    uri = files[0][0]
    ids, mask, _, _ = next(token_arrow.sequences(uri))
    assert ids.shape[1] == 64 and (token_arrow.sequence(uri.removeprefix("file://"), 0) == ids[0]).all() and mask[0].all()
    assert token_arrow.read_tokens(spark, token_arrow.write_tokens(cases.empty(spark), scratch)).count() == 0
