"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised by rank, a row's cell has a place on the Hilbert curve, and rows in the
order of that place are cut into runs of equal length. Neighbours on the curve are neighbours in every dimension, so
each run covers a small box and files can be skipped by bounds on any of the dimensions. A value's coordinate is the
middle of its ranks on the whole grid, so that a dimension of few values, too, spreads over the curve's upper levels.
Everything is DataFrame functions.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import LEAST, Ranges
from ._store import Scratch

BITS = 6
SHARDS = 16
#: parts into which the rows of a cell are dealt before they are numbered, at least; else one for so many rows of all
PARTS = 64
PART_ROWS = 200_000


def curve_table(dims: int) -> list[int]:
    """The curve's state machine: entry state * 2**dims + corner is (place among the corners) + 2**dims * next state.

    A state is the corner where a cell is entered and the axis along which its curve leaves.
    """
    corners = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (corners - 1)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    place_of = {gray(i): i for i in range(corners)}

    def entry(w: int) -> int:
        return gray((w - 1) // 2 * 2) if w else 0

    def axis(w: int) -> int:
        x = w if w % 2 else w - 1
        return (((x + 1) & -(x + 1)).bit_length() - 1) % dims if w else 0

    out = []
    for state in range(corners * dims):
        e, d = divmod(state, dims)
        for corner in range(corners):
            w = place_of[turn(corner ^ e, dims - (d + 1) % dims)]
            e2, d2 = e ^ turn(entry(w), d + 1), (d + axis(w) + 1) % dims
            out.append(w + corners * (e2 * dims + d2))
    return out


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell whose coordinates have so many bits."""
    corners = 1 << len(cells)
    table = F.array(*[F.lit(x) for x in curve_table(len(cells))])
    at = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, i: Column) -> Column:
        corner = sum((F.getbit(at[j], i).cast("int") * (1 << j) for j in range(len(cells))), F.lit(0))
        found = F.element_at(table, acc["s"] * corners + corner + 1)
        return F.struct((acc["h"] * corners + found % corners).alias("h"), F.floor(found / corners).cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def text_key(column: Column, prefix: bytes) -> Column:
    """The seven bytes behind a prefix that all values have, as an integer in the order of the strings."""
    hexed = F.substring(F.hex(F.encode(column, "UTF-8")), 2 * len(prefix) + 1, 14)
    return F.conv(F.rpad(hexed, 14, "0"), 16, 10).cast("long")


def coordinates(quantiles: list[int]) -> tuple[list[int], list[int]]:
    """Bounds of value ranges and each range's coordinate, from the quantiles that part a dimension's ranks in cells.

    The range behind a bound that is several quantiles lies in the middle of them.
    """
    bounds = sorted(set(quantiles) - {LEAST})
    low = sum(q == LEAST for q in quantiles)
    below = [sum(q < b for q in quantiles) for b in bounds]
    equal = [sum(q == b for q in quantiles) for b in bounds]
    return bounds, [(low + 1) // 2 if low else 0, *((2 * x + y + 1) // 2 for x, y in zip(below, equal, strict=True))]


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """A cell coordinate for each dimension, from approximate quantiles; null is in the lowest cell."""
    kinds = dict(df.dtypes)
    strings = [d for d in dims if kinds[d] == "string"]
    prefix = {}
    if strings:
        ends = df.agg(*[f(d).alias(f"{d}_{i}") for d in strings for i, f in enumerate((F.min, F.max))]).first()
        prefix = {d: commonprefix([(ends[f"{d}_{i}"] or "").encode() for i in (0, 1)]) for d in strings}
    keys = [F.coalesce(text_key(F.col(d), prefix[d]) if d in prefix else F.col(d).cast("long"), F.lit(LEAST)) for d in dims]
    at = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    found = df.agg(*[F.percentile_approx(k, at, 10_000).alias(str(i)) for i, k in enumerate(keys)]).first()
    out = []
    for i, k in enumerate(keys):
        bounds, cells = coordinates(found[str(i)] or [])
        out.append(Ranges(bounds).pick(k, [F.lit(c) for c in cells]))
    return out


def shards(df: DataFrame, dims: list[str], order: list[str], scratch: Scratch, n: int = SHARDS, bits: int = BITS) -> DataFrame:
    """df with ``curve``, ``shard`` (0 to n - 1) and ``slot`` (from 0 in each shard); shards differ by a row at most.

    The three take the place of columns of those names. Rows are in the order of the curve, in a cell by a hash of
    the first column of ``order`` and then by ``order``, so rows of a cell that are equal in the first lie together.
    A cell with any share of the rows is numbered in parts, and so is a value of the first column with a thousandth
    of all rows; only counts are summed up across cells, by cells of the curve's upper levels first. Repeated rows
    take neighbouring slots.
    """
    df = df.drop("curve", "shard", "slot")
    # the rows in one column, so that no name of theirs meets one from here
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(packed, curve_index(quantised(df, dims, bits), bits).alias("curve"), F.xxhash64(order[0]).alias("_own"))
    rows = scratch.keep(rows, "cells")
    keys = [F.col("row")[c] for c in order]
    total = rows.count()
    # at most a thousand rows
    hot = (
        rows.groupBy("_own")
        .agg(F.count("*").alias("_times"))
        .filter(F.col("_times") >= max(1000, total // 1000))
        .select("_own", F.lit(True).alias("_hot"))
    )
    rows = rows.join(F.broadcast(hot), "_own", "left")
    parts = max(PARTS, total // PART_ROWS)
    rows = rows.withColumns({"_part": F.pmod("_own", F.lit(parts)), "_own": F.when(F.col("_hot"), F.col("_own"))}).withColumn(
        "_sub", F.when(F.col("_hot"), F.pmod(F.xxhash64(*keys), F.lit(parts)))
    )
    place = ["curve", "_part", "_own", "_sub"]
    counts = scratch.keep(rows.groupBy(*place).agg(F.count("*").alias("n")), "counts")
    block = F.shiftright("curve", max(0, bits * len(dims) - 12))
    counts = counts.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    # at most 2 ** 12 rows
    ahead = counts.groupBy("_block").agg(F.sum("n").alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    offsets = counts.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        F.broadcast(ahead.select("_block", "ahead")), "_block"
    )
    offsets = offsets.select(*[F.col(c).alias(f"_at{c}") for c in place], (F.col("within") + F.col("ahead")).alias("_first"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy(*keys)))
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"_at{c}"))
    rank = F.col("_first") + F.col("_n") - 1
    placed = numbered.join(offsets, same).withColumn("_rank", rank).withColumn(
        "shard", F.expr(f"cast(_rank * {n} div {max(1, total)} as int)")
    )
    slot = F.col("_rank") - F.expr(f"(cast(shard as bigint) * {total} + {n - 1}) div {n}")
    return placed.withColumn("slot", slot.cast("int")).select("row.*", "curve", "shard", "slot")


def described(docs: DataFrame) -> DataFrame:
    """docs with ``size`` and ``text_crc32``; a null text has no bytes, so size 1 and the checksum 0."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(F.encode(body, "UTF-8"))})


def write_shards(df: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """Write df's rows as Parquet, a folder a shard, in the order of slots; placed has key, shard and slot.

    A row meets its place by all columns that both have, for documents by size and checksum too; rows equal in
    these take the places one each, so that null and repeated keys stay as many as they are.
    """
    rows = described(df) if {"size", "text_crc32"} <= set(placed.columns) and "text" in df.columns and not {"size", "text_crc32"} & set(
        df.columns
    ) else df
    if key not in df.columns or key not in placed.columns:
        raise ValueError(f"{key} must be a column of both frames")
    both = [c for c in rows.columns if c in placed.columns and c not in ("shard", "slot")]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*both).orderBy(F.xxhash64(*df.columns))))
    places = placed.withColumn("_m", F.row_number().over(Window.partitionBy(*both).orderBy("shard", "slot")))
    places = places.select(*[F.col(c).alias(f"_at_{c}") for c in both], "_m", "shard", "slot")
    same = F.col("_n") == F.col("_m")
    for c in both:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    joined = rows.drop("shard", "slot").join(places, same).select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, scratch: Scratch, n: int = SHARDS) -> DataFrame:
    """Shards of documents by source, language and size, under the law that shards have equal counts.

    A null text has no bytes, so size 1 and the checksum 0. Null dimensions lie in the lowest cell. Rows that
    repeat, or share a doc_id, are placed one by one. Equal texts of one source and language are neighbours; those
    of other sources lie where their source does, as a filter on it would else skip no shard.
    """
    rows = described(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "size", "text_crc32")
    return shards(rows, ["source", "lang", "size"], ["text_crc32", "size", "doc_id"], scratch, n)
