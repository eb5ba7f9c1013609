"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of consecutive words of a benchmark item (all of a shorter item). A document that holds a
window holds each of the window's shingles, so any one of them is a sufficient prefix: the one that the fewest
documents hold. Documents are matched on those shingles alone; where in the document the window would start,
and whether it would fit, follows from the shingle's place in it; what is left is compared word by word.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, file_system, write_whole
from ._text import LETTERS, Words, window_hash, word_runs

WINDOW = 13
SHINGLE = 3
#: bytes of benchmark text in a block
BLOCK_BYTES = 16 << 20
#: bytes of blocks that a worker keeps (a block takes some four to six times its text), and bytes of documents that
#: meet one block after the other where it can't keep all
KEPT_BYTES = 256 << 20
HELD_BYTES = 32 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<first:long,last:long>>"


@dataclass
class Block:
    """The distinct windows of some items, in the order of their prefixes."""

    words: np.ndarray  # word hashes of all items in a row
    start: np.ndarray  # by window: its first word there
    length: np.ndarray  # and its number of words
    key: np.ndarray  # its prefix, ascending
    place: np.ndarray  # and where in it that is
    at: np.ndarray  # window w is in the items owner[at[w]:at[w + 1]]
    owner: np.ndarray
    names: np.ndarray  # the items' names in UTF-8, one after the other
    name_at: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def items_of(self, w: int) -> list[str]:
        return [bytes(self.names[self.name_at[i] : self.name_at[i + 1]]).decode() for i in self.owner[self.at[w] : self.at[w + 1]].tolist()]


@dataclass
class _Windows:
    """Distinct windows before their prefixes are chosen."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    at: np.ndarray
    owner: np.ndarray


def windows_of(texts: list[str], window: int = WINDOW) -> _Windows:
    hashes, bounds = [], [0]
    for words in word_runs(pa.array(texts, pa.large_string()), LETTERS):
        hashes.append(words.hash)
        bounds.extend((words.bounds[1:] + bounds[-1]).tolist())
    h, bounds = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.array(bounds)
    counts = np.diff(bounds)
    m = np.minimum(counts, window)
    number = np.where(counts > 0, counts - m + 1, 0)
    owner = np.repeat(np.arange(len(counts)), number)
    start = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + bounds[:-1][owner]
    length = m[owner]
    whole = np.zeros(len(start), np.uint64)
    for k in np.unique(length):
        rows = length == k
        whole[rows] = window_hash(h, int(k))[start[rows]]
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    pair = np.unique(group.ravel() * np.int64(max(1, len(counts))) + owner) if len(first) else np.zeros(0, np.int64)
    of, owner = pair // max(1, len(counts)), pair % max(1, len(counts))
    return _Windows(h, start[first], length[first], np.searchsorted(of, np.arange(len(first) + 1)), owner)


def _by_length(found: _Windows, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Windows of one length: which, the hash of each shingle place of the block, and how many shingles they have."""
    for k in np.unique(found.length):
        n = min(int(k), shingle)
        yield np.flatnonzero(found.length == k), window_hash(found.words, n), int(k) - n + 1


def distinct_shingles(found: _Windows, shingle: int = SHINGLE) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    for rows, hashes, number in _by_length(found, shingle):
        inside = np.zeros(len(hashes), bool)
        for j in range(number):
            inside[found.start[rows] + j] = True
        parts.append(hashes[inside])
    return np.unique(np.concatenate(parts))


def make_block(names: list[str], found: _Windows, shingles: np.ndarray, counts: np.ndarray, shingle: int = SHINGLE) -> Block:
    """Each window's prefix is its rarest shingle; among equally rare ones that with the smallest hash, so that windows
    next to each other choose alike."""
    rank = np.empty(len(shingles), np.int64)
    rank[np.lexsort((shingles, counts))] = np.arange(len(shingles))
    key, place = np.zeros(len(found.start), np.uint64), np.zeros(len(found.start), np.int64)
    for rows, hashes, number in _by_length(found, shingle):
        best = np.full(len(rows), np.iinfo(np.int64).max)
        for j in range(number):
            h = hashes[found.start[rows] + j]
            own = rank[np.searchsorted(shingles, h)]
            less = own < best
            best[less], place[rows[less]], key[rows[less]] = own[less], j, h[less]
    order = np.argsort(key, kind="stable")
    sizes = np.diff(found.at)[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = found.owner[np.repeat(found.at[:-1][order] - at[:-1], sizes) + np.arange(at[-1])] if len(order) else found.owner
    data = [x.encode() for x in names]
    return Block(
        found.words,
        found.start[order],
        found.length[order],
        key[order],
        place[order],
        at,
        owner,
        np.frombuffer(b"".join(data), np.uint8),
        np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]),
    )


def _doc_shingles(words: Words, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, place) of the run's shingles inside documents: of the full length, then of each shorter one, which
    only windows of fewer words have."""
    doc = words.doc_of_word()
    for n in range(shingle, 0, -1):
        h = window_hash(words.hash, n)
        inside = np.flatnonzero(doc[: len(h)] == doc[n - 1 : n - 1 + len(h)])
        yield h[inside], inside


def _found(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Where values are among the keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.flatnonzero(sorted_keys[at] == values)


def matches(words: Words, block: Block, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of the block's windows in the run."""
    if not len(block.key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = words.doc_of_word()
    starts, windows = [], []
    least = int(min(block.length.min(), shingle))
    for n, (h, at) in zip(range(shingle, 0, -1), _doc_shingles(words, shingle), strict=True):
        if n < least:
            break
        hit = _found(h, block.key)
        lo, hi = np.searchsorted(block.key, h[hit], "left"), np.searchsorted(block.key, h[hit], "right")
        times = hi - lo
        w = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        start = np.repeat(at[hit], times) - block.place[w]
        # bounds by place and length: the window begins and ends inside the document
        own = doc[np.repeat(at[hit], times)]
        fits = (start >= words.bounds[own]) & (start + block.length[w] <= words.bounds[own + 1])
        start, w = start[fits], w[fits]
        for j in range(int(block.length.max())):
            same = (j >= block.length[w]) | (
                words.hash[np.minimum(start + j, len(words.hash) - 1)] == block.words[np.minimum(block.start[w] + j, len(block.words) - 1)]
            )
            start, w = start[same], w[same]
        starts.append(start)
        windows.append(w)
    return np.concatenate(starts), np.concatenate(windows)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: words, words inside an occurring window, items with occurring windows, and the hit spans.

    Words are runs of ASCII letters, digits and everything beyond ASCII, with A-Z in lower case. Null texts have
    no words; a null item_id counts as an item named "". Rows that share an item_id are one item with several
    texts. The benchmark lies in blocks of bounded size in the shared folder, made once; other columns of either
    table, whatever their names, play no part.
    """
    blocks = _prepared(docs, items, scratch, text, item_id, item_text, window, shingle, block_bytes)
    scan = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits in _hits(batches, 1, blocks, shingle):
            yield _report(b.column(0), hits)

    return scan.mapInArrow(find, SCHEMA)


def _prepared(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str, item_id: str, item_text: str, window: int, shingle: int, block_bytes: int) -> list[str]:
    """The benchmark's blocks as files: items dealt by a hash, their shingles, how many documents have each, blocks."""
    spark = docs.sparkSession
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = rows.distinct().withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))).repartition("block")
    dealt.write.partitionBy("block").parquet(texts := scratch.path("items"))
    folder = scratch.path("blocks")
    paths = [[f"{folder}/{kind}-{k:06d}.npz" for k in range(n)] for kind in ("shingles", "block")]

    def windows(k: int) -> tuple[list[str], _Windows]:
        names, found = _read_items(f"{texts}/block={k}")
        return names, windows_of(found, window)

    _each(spark, n, lambda k: _save(paths[0][k], {"shingles": distinct_shingles(windows(k)[1], shingle)}))
    counted = scratch.path("rarity")
    _rarity(docs.select(F.col(text).alias("text")), paths[0], shingle).write.partitionBy("block").parquet(counted)

    def make(k: int) -> None:
        names, found = windows(k)
        shingles = _load(paths[0][k])["shingles"]
        h, times = _read_counts(f"{counted}/block={k}")
        counts = np.zeros(len(shingles), np.int64)
        hit = _found(h, shingles)
        counts[np.searchsorted(shingles, h[hit])] = times[hit]
        _save(paths[1][k], vars(make_block(names, found, shingles, counts, shingle)))

    _each(spark, n, make)
    return paths[1]


def _each(spark: SparkSession, n: int, run) -> None:
    """Run something for the numbers below n, a task each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                run(k)
            yield b

    spark.range(0, n, 1, n).mapInArrow(task, "id long").write.format("noop").mode("overwrite").save()


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    write_whole(uri, out.getvalue())


def _load(uri: str) -> dict[str, np.ndarray]:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        found = np.load(io.BytesIO(f.read()), allow_pickle=False)
    return {k: found[k] for k in found.files}


def _read_folder(uri: str, columns: list[str]) -> pa.Table | None:
    """A partition's rows; none if nothing was written for it."""
    import pyarrow.parquet as pq
    from pyarrow import fs as kinds

    fs, path = file_system(uri)
    return pq.ParquetDataset(path, filesystem=fs).read(columns) if fs.get_file_info(path).type == kinds.FileType.Directory else None


def _read_items(uri: str) -> tuple[list[str], list[str]]:
    t = _read_folder(uri, ["name", "text"])
    return (t.column("name").to_pylist(), t.column("text").to_pylist()) if t is not None else ([], [])


def _read_counts(uri: str) -> tuple[np.ndarray, np.ndarray]:
    t = _read_folder(uri, ["shingle", "n"])
    return (t.column("shingle").to_numpy().view(np.uint64), t.column("n").to_numpy()) if t is not None else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64)
    )


_kept: dict[str, object] = {}


def _block(uri: str, kind=None):
    """A file's arrays; a worker keeps the files used last, up to KEPT_BYTES."""
    if uri not in _kept:
        arrays = _load(uri)
        _kept[uri] = kind(**arrays) if kind else arrays["shingles"]
    else:
        _kept[uri] = _kept.pop(uri)
    while len(_kept) > 1 and sum(x.nbytes for x in _kept.values()) > KEPT_BYTES:
        del _kept[next(iter(_kept))]
    return _kept[uri]


def _held(batches: Iterator[pa.RecordBatch], place: int, many: bool) -> Iterator[list[tuple[pa.RecordBatch, list[Words]]]]:
    """Batches with their words; if there are many blocks, as many at once as HELD_BYTES hold."""
    held, size = [], 0
    for b in batches:
        runs = word_runs(b.column(place), LETTERS)
        if not many:
            for words in runs:
                yield [(b.slice(words.first, words.n_docs), [words])]
            continue
        held.append((b, list(runs)))
        size += b.column(place).nbytes
        if size > HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rarity(texts: DataFrame, files: list[str], shingle: int) -> DataFrame:
    """In how many documents each shingle of each block is; those in none are left out."""

    def rows(k: int, total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), k)), pa.array(_block(files[k])[some].view(np.int64)), pa.array(total[some])],
            ["block", "shingle", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for held in _held(batches, 0, len(files) > 1):
            for k, uri in enumerate(files):
                keys = _block(uri)
                # one block's counts go once a task, those of many at each turn
                total = np.zeros(len(keys), np.int64) if total is None or len(files) > 1 else total
                for _, runs in held:
                    for words in runs:
                        doc = words.doc_of_word()
                        for h, at in _doc_shingles(words, shingle):
                            hit = _found(h, keys)
                            pair = np.unique(doc[at[hit]] * np.int64(max(1, len(keys))) + np.searchsorted(keys, h[hit]))
                            total += np.bincount(pair % max(1, len(keys)), minlength=len(keys)).astype(np.int64)
                if len(files) > 1:
                    yield rows(k, total)
        if len(files) == 1 and total is not None:
            yield rows(0, total)

    return (
        texts.mapInArrow(count, "block long, shingle long, n long")
        .groupBy("block", "shingle")
        .agg(F.sum("n").alias("n"))
        .repartition("block")
    )


@dataclass
class _Hits:
    """What a run of documents has of the benchmark."""

    words: Words
    edge: np.ndarray  # at its first word a window adds one, behind its last it takes one away
    names: dict[int, set[str]]

    def hit(self) -> np.ndarray:
        return np.cumsum(self.edge[:-1]) > 0

    def counts(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.hit())])
        return sums[self.words.bounds[1:]] - sums[self.words.bounds[:-1]]


def _hits(batches: Iterator[pa.RecordBatch], place: int, blocks: list[str], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[_Hits]]]:
    for held in _held(batches, place, len(blocks) > 1):
        found = [(b, [_Hits(words, np.zeros(len(words.hash) + 1, np.int64), {}) for words in runs]) for b, runs in held]
        for uri in blocks:
            block = _block(uri, Block)
            for _, hits in found:
                for x in hits:
                    start, w = matches(x.words, block, shingle)
                    np.add.at(x.edge, start, 1)
                    np.add.at(x.edge, start + block.length[w], -1)
                    pair = np.unique(x.words.doc_of_word()[start] * np.int64(max(1, len(block.length))) + w)
                    for d, k in zip((pair // max(1, len(block.length))).tolist(), (pair % max(1, len(block.length))).tolist(), strict=True):
                        x.names.setdefault(d, set()).update(block.items_of(k))
        yield from found


def _report(ids: pa.Array, hits: list[_Hits]) -> pa.RecordBatch:
    n_words, n_hit, names, spans = [], [], [], []
    for x in hits:
        n_words.append(x.words.counts.astype(np.int64))
        n_hit.append(x.counts().astype(np.int64))
        hit = x.hit()
        for d in range(x.words.n_docs):
            names.append(sorted(x.names.get(d, ())))
            if not names[-1]:
                spans.append([])
                continue
            turn = np.diff(np.concatenate([[0], hit[x.words.bounds[d] : x.words.bounds[d + 1]].astype(np.int8), [0]]))
            spans.append(
                [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
            )
    none = np.zeros(0, np.int64)
    columns = [
        ids.cast(pa.int64()),
        pa.array(np.concatenate([none, *n_words])),
        pa.array(np.concatenate([none, *n_hit])),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array(names, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    scratch: Scratch,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that are not contaminated: without a hit, or with fewer than one word in twenty hit."""
    blocks = _prepared(docs, items, scratch, text, item_id, item_text, window, shingle, block_bytes)
    place = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits in _hits(batches, place, blocks, shingle):
            none = np.zeros(0, np.int64)
            n, hit = (np.concatenate([none, *x]) for x in zip(*((x.words.counts, x.counts()) for x in hits), strict=True)) if hits else (
                none, none
            )
            yield b.filter(pa.array(~((hit > 0) & (20 * hit >= n)), pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_contamination's result."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
