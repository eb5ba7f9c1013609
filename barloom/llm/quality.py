"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors. The sum over all pairs is half of
(square of the sum) - (sum of the squares), so a score takes time linear in a document's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, free_name
from ._text import NON_SPACE, Words, mix, word_runs, words_of

#: word features; behind them 32 for each statistic, then 64 for each metadata column
WORDS = 1 << 12
BINS = 32
META = 64
RANK = 8
#: at most so many labelled rows are learnt from, the first in the order of a hash of doc_id
SAMPLE = 12_000
EPOCHS = 12
RATE = 0.02
#: decay for words, for the rest
DECAY = (2e-3, 1e-5)
THRESHOLD = 0.3
FOLDS = 5

_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
_COMMON_SIGNS, _BARS = _set(".,;:'\"-()"), _set("|")
_SIGNS = np.zeros(256, bool)
_SIGNS[0x21:0x7F] = True
_SIGNS &= ~(_UPPER | _LOWER | _DIGIT | _COMMON_SIGNS | _BARS)
_SENTENCE = _set(".?!")


def statistics(words: Words) -> np.ndarray:
    """(documents, statistics), each between 0 and 1."""

    def per_doc(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    raw, at, n = words.raw, words.offsets, words.counts.astype(float)
    size = np.maximum(np.diff(at), 1).astype(float)
    count = np.maximum(n, 1)
    upper, lower = per_doc(_UPPER[raw], at), per_doc(_LOWER[raw], at)
    signs, bars = per_doc(_SIGNS[raw], at), per_doc(_BARS[raw], at)
    length = words.end - words.start
    doc = words.doc_of_word()
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    ends = words.data[words.end - 1] if len(doc) else np.zeros(0, np.uint8)

    def distinct(w: Words) -> np.ndarray:
        d, h = w.doc_of_word(), w.hash
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return np.bincount(d[new], minlength=w.n_docs).astype(float)

    lines = words_of(raw, at, _LINES)
    n_lines = np.maximum(lines.counts, 1)
    line_again = 1 - distinct(lines) / n_lines * (lines.counts > 0)
    return np.column_stack(
        [
            np.minimum(np.log2(1 + n) / 16, 1),
            np.minimum(np.log2(1 + np.diff(at)) / 20, 1),
            np.minimum(per_doc(length, words.bounds) / count / 32, 1),
            upper / np.maximum(upper + lower, 1),
            np.sqrt(signs / size),
            np.sqrt(bars / size),
            np.sqrt(per_doc(_DIGIT[raw], at) / size),
            per_doc(_COMMON_SIGNS[ends], words.bounds) / count,
            per_doc(_SIGNS[ends], words.bounds) / count,
            distinct(words) / count,
            per_doc(again, words.bounds) / count,
            np.where(lines.counts > 0, line_again, 0),
            np.minimum(np.log2(1 + count / n_lines) / 12, 1),
            np.sqrt(np.minimum(per_doc(_SENTENCE[raw], at) / count, 1)),
            per_doc(length > 20, words.bounds) / count,
            np.diff(at) == 0,
        ]
    )


N_STATS = 16


def features(texts: pa.Array, meta: list[pa.Array]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: first row, bounds, feature numbers and values.

    Words count once, by one over the root of their number; a statistic is shared by the two bins next to it; a
    metadata value is a category if a string and else its binary logarithm.
    """
    for words in word_runs(texts, NON_SPACE):
        doc = words.doc_of_word()
        key = np.unique(doc * np.int64(WORDS) + (words.hash % np.uint64(WORDS)).astype(np.int64))
        wd, wf = key // WORDS, key % WORDS
        per = np.bincount(wd, minlength=words.n_docs)
        docs, numbers, values = [wd], [wf], [1 / np.sqrt(per[wd])]
        stats = statistics(words) * (BINS - 1)
        low = np.minimum(stats.astype(np.int64), BINS - 2)
        base = WORDS + np.arange(N_STATS) * BINS
        every = np.repeat(np.arange(words.n_docs), N_STATS)
        for shift, weight in ((0, 1 - (stats - low)), (1, stats - low)):
            docs.append(every)
            numbers.append((base + low + shift).ravel())
            values.append(weight.ravel())
        for k, column in enumerate(meta):
            docs.append(np.arange(words.n_docs))
            numbers.append(WORDS + N_STATS * BINS + k * META + _category(column.slice(words.first, words.n_docs)))
            values.append(np.full(words.n_docs, 0.5))
        docs, numbers, values = (np.concatenate(x) for x in (docs, numbers, values))
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        yield words.first, np.searchsorted(docs, np.arange(words.n_docs + 1)), numbers[order], values[order].astype(np.float32)


def _category(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        w = [
            int(mix(np.array([hash_bytes(x)], np.uint64))[0] % np.uint64(META - 1)) + 1 if x is not None else 0 for x in column.to_pylist()
        ]
        return np.array(w, np.int64)
    x = np.array([np.nan if v is None else float(v) for v in column.to_pylist()])
    return np.where(np.isnan(x), 0, 1 + np.minimum(2 * np.log2(1 + np.maximum(np.nan_to_num(x), 0)), META - 2)).astype(np.int64)


def hash_bytes(s: str) -> int:
    import zlib

    data = s.encode()
    return zlib.crc32(data) << 32 | zlib.crc32(data[::-1])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # (features, RANK)
    metadata: tuple[str, ...] = ()

    def logits(self, bounds: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Linear part and half of square of sums less sum of squares, for every document; none is empty."""
        vx = self.factor[numbers] * values[:, None]
        at = bounds[:-1]
        sums = np.add.reduceat(vx, at)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        return self.bias + np.add.reduceat(self.weight[numbers] * values, at) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learnt from; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    metadata: tuple[str, ...] = ("n_chars",),
    sample: int = SAMPLE,
) -> Machine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; without any, every score is 0.5.

    Labels that are null, or that say different things of one doc_id, teach nothing. Of documents that share a
    labelled doc_id one is learnt from, that with the least hash, so the driver never gets more than ``sample`` rows
    of at most a feature for each of WORDS and a few hundred others.
    """
    names = (doc_id, label)
    known = labels.select(*names).filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).filter("_y = _z")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", F.col("_y").cast("int").alias("_y"))
    metadata = tuple(m for m in metadata if m in docs.columns)
    values = ["_text", *(f"_m{i}" for i in range(len(metadata)))]
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *[F.col(m).alias(f"_m{i}") for i, m in enumerate(metadata)])
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min_by(F.struct(*values), F.xxhash64(*values)).alias("_x"))
    rows = rows.select("_y", *[F.col("_x")[v].alias(v) for v in values], F.xxhash64("_id").alias("_order"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = [b.column(2 + i) for i in range(len(metadata))]
            for first, bounds, numbers, values in features(b.column(1), meta):
                n = len(bounds) - 1
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (numbers.astype(np.int32), values)
                ]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), b.column(2 + len(metadata)).slice(first, n), *lists], ["y", "order", "numbers", "values"]
                )

    made = scratch.keep(rows.mapInArrow(extract, "y int, order long, numbers array<int>, values array<float>"), "sample")
    table = made.orderBy("order", "y").toArrow().combine_chunks()
    scratch.drop(made)
    size = WORDS + N_STATS * BINS + META * len(metadata)
    if not table.num_rows:
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK)), metadata)
    column = lambda name: table.column(name).combine_chunks()
    numbers, values = column("numbers"), column("values")
    bounds = np.concatenate([[0], np.cumsum(numbers.value_lengths().to_numpy())])
    machine = fit(bounds, numbers.flatten().to_numpy(), values.flatten().to_numpy(), column("y").to_numpy().astype(float), size)
    machine.metadata = metadata
    # the driver goes on to other stages
    del table, column, numbers, values, bounds
    pa.default_memory_pool().release_unused()
    return machine


def fit(bounds: np.ndarray, numbers: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, batch: int = 256) -> Machine:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(7)
    share = np.clip(y.mean(), 0.01, 0.99)
    theta = np.zeros((size, RANK + 1), np.float32)
    theta[:, 1:] = rng.normal(0, 0.05, (size, RANK))
    decay = np.where(np.arange(size) < WORDS, *DECAY)[:, None].astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    mb = vb = 0.0
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            lengths = bounds[rows + 1] - bounds[rows]
            at = np.cumsum(lengths) - lengths
            take = np.arange(lengths.sum()) + np.repeat(bounds[rows] - at, lengths)
            f, x = numbers[take], values[take]
            vx = theta[f, 1:] * x[:, None]
            sums = np.add.reduceat(vx, at)
            z = bias + np.add.reduceat(theta[f, 0] * x, at) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), at))
            e = ((sigmoid(z) - y[rows]) / len(rows)).astype(np.float32)
            ex = np.repeat(e, lengths) * x
            grad = np.zeros_like(theta)
            grad[:, 0] = np.bincount(f, ex, size)
            pull = np.repeat(sums, lengths, axis=0) - vx
            for k in range(RANK):
                grad[:, k + 1] = np.bincount(f, ex * pull[:, k], size)
            grad += decay * theta
            step += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            mb, vb = 0.9 * mb + 0.1 * float(e.sum()), 0.999 * vb + 0.001 * float(e.sum()) ** 2
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Machine(bias, theta[:, 0].astype(np.float64), theta[:, 1:].astype(np.float64))


def score(
    docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """docs' columns ``keep`` (all if not given) with the score and the prediction, in place of any columns of those
    two ``names``.

    A null text is an empty one and scored as such.
    """
    keep = [c for c in (keep or docs.columns) if c not in names]
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size
    own = docs.select(*[F.col(f"`{c}`") for c in keep])
    # inputs go by place, under names that the documents don't have
    inputs = [F.col(text), *[F.col(m) for m in machine.metadata]]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(free_name(f"_in{i}", keep)) for i, c in enumerate(inputs)])
    schema = own.select("*", F.lit(0.0).cast("double").alias(names[0]), F.lit(0).cast("int").alias(names[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            found = [sigmoid(own.logits(bounds, numbers, values)) for _, bounds, numbers, values in features(b.column(len(keep)), [b.column(len(keep) + 1 + i) for i in range(len(own.metadata))])]
            x = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(x), pa.array((x >= THRESHOLD).astype(np.int32))], [*keep, *names]
            )

    return rows.mapInArrow(run, schema)
