"""Document fingerprints by threshold-scaled sketches.

Every word shingle has a 64-bit hash; a fingerprint keeps each hash below a fixed fraction of the hash space.
What is kept depends on the shingle alone, so sketches of parts unite to the sketch of the whole, and the share
of one document inside another can be told however unequal they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranges import LEAST, id_key, id_ranges
from ._text import NON_SPACE, shingles, word_runs

SHINGLE = 5
#: a hash in so many is kept
SCALE = 4


def sketches(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[tuple[np.ndarray, int, int]]:
    """Per text: kept hashes in ascending order, number of words, sum of the word hashes."""
    out, limit = [], np.uint64((1 << 64) // scale - 1)
    for words in word_runs(texts, NON_SPACE):
        docs, hashes = shingles(words, shingle)
        below = hashes <= limit
        docs, hashes = docs[below], hashes[below]
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        docs, hashes = docs[new], hashes[new]
        at = np.searchsorted(docs, np.arange(words.n_docs + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash)])
        sums = (total[words.bounds[1:]] - total[words.bounds[:-1]]).tolist()
        out += [(hashes[a:b], n, s) for a, b, n, s in zip(at[:-1], at[1:], words.counts.tolist(), sums, strict=True)]
    return out


def to_string(sketch: tuple[np.ndarray, int, int], scale: int = SCALE) -> str:
    """"scale:words:sum of word hashes:kept hashes" with the hashes as base64 of little-endian 64-bit integers."""
    kept, n, total = sketch
    return f"{scale}:{n}:{total:x}:{base64.b64encode(kept.astype('<u8').tobytes()).decode()}"


def from_string(s: str) -> tuple[np.ndarray, int, int]:
    _, n, total, kept = s.split(":")
    return np.frombuffer(base64.b64decode(kept), "<u8"), int(n), int(total, 16)


def merge(*prints: str) -> str:
    """Fingerprint of several documents as one collection: kept hashes unite, words and sums add up."""
    parts = [from_string(x) for x in prints]
    kept = np.unique(np.concatenate([x[0] for x in parts])) if parts else np.zeros(0, np.uint64)
    scale = int(prints[0].partition(":")[0]) if prints else SCALE
    return to_string((kept, sum(x[1] for x in parts), sum(x[2] for x in parts) % (1 << 64)), scale)


def likeness(a: tuple[np.ndarray, int, int], b: tuple[np.ndarray, int, int]) -> float:
    """Estimated Jaccard similarity of the shingle sets.

    Where neither sketch holds a hash, 1 for equal bags of words and 0 otherwise.
    """
    if not len(a[0]) and not len(b[0]):
        return float(a[1:] == b[1:])
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return both / (len(a[0]) + len(b[0]) - both)


def containment(a: tuple[np.ndarray, int, int], b: tuple[np.ndarray, int, int]) -> float:
    """Estimated share of a's shingles that b has too; of an empty sketch as likeness."""
    if not len(a[0]):
        return float(a[1:] == b[1:])
    return len(np.intersect1d(a[0], b[0], assume_unique=True)) / len(a[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with a fingerprint column added (in place of one of that name); a null text is an empty one."""
    keep = df.drop(out)
    schema = keep.withColumn(out, F.lit("").cast("string")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [to_string(x, scale) for x in sketches(b.column(text), shingle, scale)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, out])

    return keep.mapInArrow(add, schema)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document in
    descending doc_id. Null texts are empty; a null doc_id comes last; rows of one doc_id are ordered by a hash
    of the text. Texts move once, by ranges of doc_id; of each range the first row goes to the range before it
    as well, so that every row meets its next one.
    """
    ranges = id_ranges(docs, doc_id)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), id_key(doc_id).alias("key")
    )
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("p", ranges.pick(F.col("key")))
    # a row a range
    firsts = sorted(rows.groupBy("p").agg(F.max(F.struct("key", "tie")).alias("top")).select("p", "top.key", "top.tie").collect())
    # the first row of a range follows the last one of the next higher range
    gives = [(p, key, tie, firsts[(i + 1) % len(firsts)][0]) for i, (p, key, tie) in enumerate(firsts)]
    tops = docs.sparkSession.createDataFrame(gives, "_p int, _key long, _tie long, _to int")
    first = (F.col("key") == F.col("_key")) & (F.col("tie") == F.col("_tie"))
    place = lambda p, given: F.struct(F.col(p).alias("p"), F.lit(given).alias("given"))
    both = F.when(first, F.array(place("p", 0), place("_to", 1))).otherwise(F.array(place("p", 0)))
    dealt = rows.join(F.broadcast(tops), rows.p == tops["_p"]).withColumn("place", F.explode(both))
    dealt = dealt.select("doc_id", "text", "key", "tie", F.col("place.p").alias("p"), F.col("place.given").alias("given"))
    dealt = dealt.repartitionById(ranges.n, F.col("p")).sortWithinPartitions("p", "given", F.desc("key"), F.desc("tie"))
    return dealt.select("doc_id", "text", "p", "given").mapInArrow(_edit, SCHEMA)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # the row that waits for its next one
    for b in batches:
        rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        pairs, waits = [], last
        for row in rows:
            if waits is not None and waits[2] == row[2] and waits[3] == 0:
                pairs.append((waits, row))
            waits = row if row[3] == 0 else None
        last = waits
        step = 2000
        for i in range(0, len(pairs), step):
            yield _compared(pairs[i : i + step])


def _compared(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
    texts = [a[1] for a, _ in pairs]
    edited = []
    for a, b in pairs:
        n = len(a[1]) // 2
        edited.append(a[1][: len(a[1]) - n] + b[1][:n])
    # each row is the next one of the row before it, but at the ends of runs
    nexts = [i for i in range(len(pairs)) if i + 1 == len(pairs) or pairs[i][1] is not pairs[i + 1][0]]
    made = sketches(pa.array([*texts, *(pairs[i][1][1] for i in nexts)], pa.large_string()))
    own, far = made[: len(pairs)], dict(zip(nexts, made[len(pairs) :], strict=True))
    own_edited = sketches(pa.array(edited, pa.large_string()))
    following = [far[i] if i in far else own[i + 1] for i in range(len(pairs))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([to_string(x) for x in own], pa.string()),
            pa.array([to_string(x) for x in own_edited], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, own_edited, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
            pa.array([containment(b, a) for a, b in zip(own, own_edited, strict=True)], pa.float64()),
        ],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )
