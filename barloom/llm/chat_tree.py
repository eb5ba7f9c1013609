"""Chat formatting on a prefix tree.

Conversations that share their first turns share the nodes of a tree. The nodes' texts are laid out once, depth
first, in one long row of tokens: code points, or the ids of a tokenizer file. A node knows where its tokens begin,
the position id of the first (tokens of its ancestors), the intervals that it may attend to (its ancestors and itself)
and its loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, join_hot

# fixed values: the template's marks
BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"

#: turns of a path that one interval covers at most
CHAIN = 64


def escape(s: str) -> str:
    """Without "<|", so that no control string is left; a backslash stands before what must not be read."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def segment(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and where its text begins and ends."""
    head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every turn: the node of its conversation's turns so far."""
    for b in batches:
        rows = []
        for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent = ""
            for depth, t in enumerate(turns):
                role, text = t["role"], t["text"]
                node = hashlib.blake2b(f"{parent}\0{len(role)}\0{role}{text}".encode(), digest_size=16).hexdigest()
                rows.append((conv, node, parent, depth, len(turns) - 1 == depth, role, text))
                parent = node
            if len(rows) > 2000:
                yield _batch(rows, _TURNS)
                rows = []
        yield _batch(rows, _TURNS)


_TURNS = "conv_id long, node string, parent string, depth int, leaf boolean, role string, text string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], _KINDS[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields]
    )


_LAID = "node string, parent string, part int, begin long, chain_begin long, above string, length long, tokens string, loss_from long, loss_to long, ids array<int>, learnt_from long, learnt_to long"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def segment_ids(made: str, first: int, last: int, path: str) -> tuple[list[int], int, int]:
    """A segment's ids, and where those of its text begin and end: what stands before the text, the text and what
    stands behind it are encoded apart, so that no token reaches over."""
    parts = [e.ids for e in _tokenizer(path).encode_batch([made[:first], made[first:last], made[last:]], add_special_tokens=False)]
    return [*parts[0], *parts[1], *parts[2]], len(parts[0]), len(parts[0]) + len(parts[1])


def _laid_out(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """The segments of a sorted partition, where each begins in it, and its chain: the run of nodes, each the first
    child of the one before, that it ends. A chain begins anew with each partition and after CHAIN nodes."""
    from pyspark import TaskContext

    at, part = 0, TaskContext.get().partitionId()
    before, chain, above, run = None, 0, "", 0
    for b in batches:
        rows = []
        for node, parent, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if before is None or parent != before or run >= CHAIN:
                chain, above, run = at, parent, 0
            made, first, last = segment(role, text)
            learnt = role == LEARNT
            ids, a, z = segment_ids(made, first, last, path) if path else (None, None, None)
            length = len(made if ids is None else ids)
            loss = (first, last, ids, a, z) if learnt else (None, None, ids, None, None)
            rows.append((node, parent, part, at, chain, above, length, made, *loss))
            at, run, before = at + length, run + 1, node
        yield _batch(rows, _LAID)


def spread_join(
    big: DataFrame, small: DataFrame, key: str, alone: Column, count: str, total: int, parts: int = 200, within: Column | None = None
) -> DataFrame:
    """Join on key where one key may have most of big's rows: such a key's row of small is repeated, and its rows
    of big are dealt over the repeats. ``count`` has the rows of big by key; at most ``parts`` keys are repeated.
    ``within`` is one more condition."""
    most = max(1000, total // parts)
    copies = F.ceil(F.col(count) / most).cast("int")
    hot = small.filter(F.col(count) > most).groupBy(key).agg(F.first(count).alias(count)).select(
        F.col(key).alias("_hot"), copies.alias("_copies")
    )
    dealt = (
        big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(alone), F.coalesce("_copies", F.lit(1))).cast("int"))
        .drop("_hot", "_copies")
    )
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    joined = dealt.join(repeated, [key, "_salt"])
    return (joined if within is None else joined.filter(within)).drop("_salt")


def build(conversations: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, leaves) of the conversations' prefix tree.

    segments, a row a node in depth-first order of ``start``: node, parent, chain (where its chain begins), start,
    length, position, intervals (of its ancestors and itself, as (start, end), the root first; neighbours that follow
    each other are one, up to CHAIN of them), tokens (the text), loss_from and loss_to (inside the segment, null if
    nothing is learnt from it). leaves: conv_id and its last node.
    With a tokenizer file start, length, position and intervals count its ids, which are in ``ids``, and learnt_from
    and learnt_to are the learnt ones inside the segment; else they count code points and these three are null.
    A conversation's turns are ordered by turn, role and text, null first; a null role or text is empty; each row with
    a null conv_id is a conversation of one turn; repeated rows are turns of their own.
    """
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        alone.alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")
    turns = scratch.keep(grouped.mapInArrow(_nodes, _TURNS), "turns")
    leaves = turns.filter("leaf").select("conv_id", "node")
    nodes = turns.groupBy("node").agg(*[F.min(c).alias(c) for c in ("parent", "depth", "role", "text")])
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = _paths(turns, scratch).withColumnRenamed("node", "_n")
    dealt = nodes.join(paths, F.col("node") == F.col("_n")).select("node", "parent", "role", "text", "path", "depth")
    dealt = dealt.repartitionByRange(parts, "path", "depth").sortWithinPartitions("path", "depth").select("node", "parent", "role", "text")
    laid = scratch.keep(dealt.mapInArrow(lambda batches: _laid_out(batches, tokenizer), _LAID), "laid")
    ends = laid.groupBy("part").agg(F.max(F.col("begin") + F.col("length")).alias("size")).collect()  # a row a partition
    bases, at = [], 0
    for part, size in sorted(tuple(r) for r in ends):
        bases.append((part, at))
        at += size
    offsets = conversations.sparkSession.createDataFrame(bases or [(0, 0)], "part int, base long")
    placed = (
        laid.join(F.broadcast(offsets), "part")
        .withColumns({"start": F.col("base") + F.col("begin"), "chain": F.col("base") + F.col("chain_begin")})
        .drop("part", "base", "begin", "chain_begin")
    )

    above = _ancestors(placed, scratch).withColumnRenamed("chain", "_c")
    segments = placed.join(above, F.col("chain") == F.col("_c"), "left").withColumn("above", F.coalesce("spans", F.array().cast(_SPANS)))
    own = F.struct(F.col("chain").alias("start"), (F.col("start") + F.col("length")).alias("end"))
    segments = segments.withColumn("intervals", F.concat("above", F.array(own)))
    before = F.aggregate("above", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    segments = segments.withColumn("position", before + F.col("start") - F.col("chain"))
    return scratch.keep(segments.select("node", "parent", "chain", "start", "length", "position", "intervals", "tokens", "loss_from", "loss_to", "ids", "learnt_from", "learnt_to"), "segments"), scratch.keep(leaves, "leaves")


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _paths(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, path): the hashes of those nodes on its way from the root that have siblings.

    Ordered by path and then by depth, nodes are in depth-first order: nodes without siblings share the path of the
    node above, so a long conversation has a short one.
    """
    light = turns.select("conv_id", "node", "parent", "depth")
    children = light.select("parent", "node").distinct().groupBy("parent").agg(F.count("*").alias("n"))
    uses = light.filter("parent <> ''").groupBy("parent").agg(F.count("*").alias("uses"))
    forks = scratch.keep(
        children.filter("n > 1 and parent <> ''").join(uses, "parent").select("parent", F.lit(True).alias("fork"), "uses"), "forks"
    )
    total = uses.agg(F.sum("uses")).first()[0] or 0
    alone = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), "depth")
    marked = join_hot(light, forks, "parent", alone, F.col("uses") >= max(100, total // 1000))
    marked = marked.withColumn("part", F.when((F.col("parent") == "") | F.col("fork"), F.substring("node", 1, 20)).otherwise(""))
    ways = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "part"))).alias("way"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for way in b.column(0).to_pylist():
                path = ""
                for x in way:
                    path += x["part"]
                    rows.append((x["node"], path))
            yield _batch(rows, "node string, path string")

    return ways.select("way").mapInArrow(walk, "node string, path string").groupBy("node").agg(F.min("path").alias("path"))


def _ancestors(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(chain, spans): what lies above a chain's first node, as spans of chains, the root's first; chains without any are left out.

    A chain hangs on a node of another chain. Each round joins every chain with what the chain above has found so
    far, so the number of rounds is the logarithm of the longest line of chains.
    """
    heads = placed.filter("start = chain and above <> ''").select("chain", F.col("above").alias("node"))
    counts = heads.groupBy("node").agg(F.count("*").alias("n"))
    spots = placed.select("node", F.col("chain").alias("next"), (F.col("start") + F.col("length")).alias("end")).join(counts, "node")
    total = counts.agg(F.sum("n")).first()[0] or 0
    links = spread_join(heads, spots, "node", F.col("chain").cast("string"), "n", total)
    links = scratch.keep(
        links.select("chain", F.array(F.struct(F.col("next").alias("start"), "end")).cast(_SPANS).alias("spans"), "next"), "links"
    )
    while True:
        open_ = links.filter("next is not null")
        counts = open_.groupBy("next").agg(F.count("*").alias("n"))
        known = links.select(F.col("chain").alias("next"), F.col("spans").alias("_more"), F.col("next").alias("_next")).join(counts, "next")
        if known.isEmpty():
            return links.select("chain", "spans")
        on = spread_join(open_, known, "next", F.col("chain").cast("string"), "n", total)
        longer = on.select(F.col("chain").alias("_c"), F.concat("_more", "spans").alias("_longer"), F.col("_next"))
        joined = links.join(longer, F.col("chain") == F.col("_c"), "left")
        links = scratch.keep(joined.select("chain", F.coalesce("_longer", "spans").alias("spans"), F.col("_next").alias("next")), "links")


def read_back(segments: DataFrame, leaves: DataFrame) -> DataFrame:
    """Digests of every conversation, from the laid-out tokens, intervals and loss masks alone."""
    ends = leaves.groupBy("node").agg(F.count("*").alias("copies"))
    lines = segments.join(ends, "node").select(F.col("node").alias("leaf"), F.explode("intervals").alias("i")).select(
        "leaf", F.col("i.start").alias("chain"), F.col("i.end").alias("end")
    )
    counts = lines.groupBy("chain").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bodies = segments.select("chain", "start", "tokens", "loss_from", "loss_to").join(counts, "chain")
    # a chain has at most CHAIN segments
    joined = spread_join(lines, bodies, "chain", F.col("leaf"), "n", total, within=F.col("start") < F.col("end"))
    grouped = joined.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("start", "tokens", "loss_from", "loss_to"))).alias("parts"))
    digests = grouped.mapInArrow(
        _digests, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    found = digests.join(ends, digests.leaf == ends.node).drop("node").withColumnRenamed("leaf", "node")
    all_ = leaves.count()
    return spread_join(leaves, found, "node", F.coalesce(F.col("conv_id"), F.lit(-1)), "copies", all_).drop("copies", "node")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        rows = []
        for leaf, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            whole = "".join(p["tokens"] for p in parts)
            learnt = [unescape(p["tokens"][p["loss_from"] : p["loss_to"]]) for p in parts if p["loss_from"] is not None]
            turns = parse(whole)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append(
                (
                    leaf,
                    len(turns),
                    hashlib.sha256(said.encode()).hexdigest(),
                    sum(map(len, learnt)),
                    hashlib.sha256("".join(learnt).encode()).hexdigest(),
                    len(whole),
                )
            )
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        out.append((unescape(formatted[at + len(BEGIN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def position_ids(position: int, length: int) -> list[int]:
    """Position ids of a segment's tokens."""
    return list(range(position, position + length))
