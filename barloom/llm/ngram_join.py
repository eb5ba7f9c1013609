"""N-gram Jaccard join on prefixes of token combinations.

Documents are sets of word shingles; equal sets are one node. The shingles of all documents have one order: those in
the fewest nodes first, then by hash. Two sets as alike as the threshold share a shingle among the first few of each;
"few" is what one set may lack of the other, and one more. A rare shingle is indexed by itself. Frequent shingles are
dealt into classes and indexed by pairs within a class; as a pair is lost with either of its two, the prefix is
extended until the pairs outnumber what may be lacking. An entry carries how many shingles lie before it that the two
can't share, as they would have met at one of those; if that leaves too few, the two are no pair. What remains is
verified on the whole sets.

The node counts are exact and come from a shuffle, not from a sketch: nothing here grows in a task or on the driver
with the number of documents. A node sends only its shingles in the lower part of the hash space where these are
enough for its prefix and the pairs behind it, else all; the join is done in the lower part, and once more in the
whole space among the nodes that sent all. A shingle of one node needs no answer: the node knows how many it sent.
Shingles that a fixed share of all documents has are found first, are few whatever the input, and don't meet by hash.

Of an index entry's nodes only those in different components need comparing: first each node with one hub, then,
entry by entry and a few hubs at a time, all that still lie apart. So a group of copies costs a star and not all its
pairs, and no link between components is missed. A row carries its node's entries just before this one in the order of
all entries: two nodes that have one of them in common have met there, and don't meet again. It also carries a bit map
of its set's parities, as sets whose maps differ in more places than linked sets can are no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import NON_SPACE, mix, shingle_sets, word_runs
from .components import components

SHINGLE = 5
#: links need 100 * intersection >= PERCENT * union
PERCENT = 80
#: shingles of more nodes are indexed in pairs
FREQUENT = 32
#: nodes send the shingles below this part of the hash space, in eighths, if these are enough
LOW = 3
#: a shingle in one of so many documents is hot: at most so many times the shingles of a mean document are
HOT = 250
#: node counts are exact up to here; hot shingles come behind, by their counts
MOST = 1 << 20
#: hashes of one count of hot shingles
_CHUNK = 2_000_000
#: entries before its own that a row carries, and longs of its bit map
BEFORE = 3
MAP = 8
#: an index entry of more rows, and of a thousandth of all, meets in parts
PART_ROWS = 1 << 16
#: hubs of an index entry in the rounds after the first; then four times as many each
HUBS = 4

_PAIR = mix(np.arange(7001, 7003, dtype=np.uint64)) | np.uint64(1)


def lacking(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its n shingles a document may lack in one it links with."""
    return n - -(-n * percent // 100)


def _band_edges(percent: int) -> np.ndarray:
    """Sizes at which a new band begins: linked sizes are in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def _set_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes))])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * _PAIR[0]).view(np.int64)


def reach(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """So many shingles of a set of n hold its prefix and, were all frequent, as many pairs as it needs."""
    edges = _band_edges(percent)
    return lacking(n, percent) + 1 + np.maximum(1, lacking(edges[np.searchsorted(edges, n, "right")], percent) // 3)


def _is_low(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(61)) < LOW


def signatures(doc: np.ndarray, h: np.ndarray, level: np.ndarray, alone: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[
    np.ndarray, np.ndarray, np.ndarray
]:
    """(document, index entry, lead) for the prefixes of documents of n shingles, of which ``alone`` are in no other.

    doc, h and level are the other shingles, by document and then in the order of all. Two documents whose first
    common shingle is this entry's have none in common among the ``lead`` ones before it; in front of a pair of
    frequent shingles those are all rare ones, as a common rare one has an entry of its own.
    """
    need = lacking(n, percent) + 1
    rare = level <= FREQUENT
    place = alone[doc] + np.arange(len(h)) - np.searchsorted(doc, doc, "left")
    single = rare & (place < need[doc])
    docs, entries, leads = [doc[single]], [h[single]], [place[single]]
    n_rare = alone + np.bincount(doc[rare], minlength=len(n))
    more = need - n_rare
    open_ = (more[doc] > 0) & ~rare
    if open_.any():
        edges = _band_edges(percent)
        d, t = doc[open_], h[open_]
        band = np.searchsorted(edges, n[d], "right")
        for beyond in (0, 1):
            classes = np.maximum(1, lacking(edges[band + beyond - 1], percent) // 3)
            group = (mix(t ^ _PAIR[1]) % classes.astype(np.uint64)).astype(np.int64)
            # a shingle counts if its class has one before it in the document
            order = np.lexsort((np.arange(len(d)), group, d))
            first = np.ones(len(d), bool)
            first[1:] = (d[order][1:] != d[order][:-1]) | (group[order][1:] != group[order][:-1])
            counts = np.ones(len(d), np.int64)
            counts[order[first]] = 0
            begin = np.searchsorted(d, d, "left")
            before = np.concatenate([[0], np.cumsum(counts)])
            taken = (before[:-1] - before[begin]) < more[d]
            # all pairs of the taken shingles of a class
            keep = order[taken[order]]
            gd, gg, gt = d[keep], group[keep], t[keep]
            start = np.ones(len(keep), bool)
            start[1:] = (gd[1:] != gd[:-1]) | (gg[1:] != gg[:-1])
            rank = np.arange(len(keep)) - np.maximum.accumulate(np.where(start, np.arange(len(keep)), 0))
            second = np.repeat(np.arange(len(keep)), rank)
            offset = np.arange(len(second)) - np.repeat(np.cumsum(rank) - rank, rank)
            other = second - 1 - offset
            lo, hi = np.minimum(gt[second], gt[other]), np.maximum(gt[second], gt[other])
            entries.append(mix(lo * _PAIR[0] + hi * _PAIR[1] + (band[keep][second] + beyond).astype(np.uint64)))
            docs.append(gd[second])
            leads.append(n_rare[gd[second]])
    return np.concatenate(docs), np.concatenate(entries), np.concatenate(leads)


def may_link(n: np.ndarray, lead: np.ndarray, m: np.ndarray, ahead: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Can sets of n and m shingles link that share none of their first ``lead`` and ``ahead`` ones?"""
    most = np.minimum(n - lead, m - ahead)
    return 100 * most >= percent * (n + m - most)


def _keys(docs: DataFrame, shingle: int) -> DataFrame:
    """A row a document (doc_id, n, low, node), and rows of shingles that may be hot (shingle, times)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen, waiting, held, sets = ["doc_id", "n", "low", "node", "shingle", "times"], set(), [], 0, 0

        def common() -> pa.RecordBatch:
            x, times = np.unique(np.concatenate(waiting), return_counts=True)
            x, times = x[(often := times >= max(4, sets // (2 * HOT)))], times[often]
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(x.view(np.int64)), pa.array(times.astype(np.int64))], names)

        for b in batches:
            for words in word_runs(b.column(1), NON_SPACE):
                hashes, at = shingle_sets(words, shingle)
                n, none = np.diff(at), pa.nulls(words.n_docs, pa.int64())
                nodes = _set_keys(hashes, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(words.first, words.n_docs).cast(pa.int64()),
                        pa.array(n.astype(np.int64)),
                        pa.array(_low_counts(hashes, at)),
                        pa.array(nodes),
                        none,
                        none,
                    ],
                    names,
                )
                new = _unseen(nodes, n, 1, seen)
                waiting.append(hashes[np.repeat(new, n)])
                held, sets = held + len(waiting[-1]), sets + int(new.sum())
                if held > _CHUNK:
                    yield common()
                    waiting, held, sets = [], 0, 0
        if held:
            yield common()

    return docs.mapInArrow(make, "doc_id long, n long, low long, node long, shingle long, times long")


def _low_counts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_is_low(hashes))])
    return (sums[at[1:]] - sums[at[:-1]]).astype(np.int64)


def _unseen(nodes: np.ndarray, n: np.ndarray, least: int, seen: set[int]) -> np.ndarray:
    """Which sets have at least ``least`` shingles and are new to the task."""
    new = n >= least
    for k in np.flatnonzero(new).tolist():
        if (x := int(nodes[k])) in seen:
            new[k] = False
        else:
            seen.add(x)
    return new


def _hot(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hot shingles in ascending order, and their counts.

    A shingle in twice a hot one's share of the documents is in its part of the documents of so many chunks that
    the sum shows it. As documents have a mean size, there are at most HOT times as many hot ones.
    """
    total = keys.filter("shingle is null").count()
    found = (
        keys.filter("shingle is not null")
        .groupBy("shingle")
        .agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= max(FREQUENT + 1, total // HOT))
        .toArrow()
    )
    h, times = found.column("shingle").to_numpy().view(np.uint64), found.column("times").to_numpy()
    order = np.argsort(h)
    return h[order], times[order]


SENT = "hash long, node long, level int"


def _sent(texts: DataFrame, hot: tuple[np.ndarray, np.ndarray], shingle: int, least: int, percent: int) -> DataFrame:
    """(hash, node, level) of the shingles that nodes send; level is 0 but for hot ones."""
    known = texts.sparkSession.sparkContext.broadcast(hot)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, times = known.value
        for b in batches:
            for words in word_runs(b.column(0), NON_SPACE):
                hashes, at = shingle_sets(words, shingle)
                n, nodes = np.diff(at), _set_keys(hashes, at)
                new = _unseen(nodes, n, least, seen)
                whole = new & (_low_counts(hashes, at) < reach(n, percent))
                send = np.repeat(whole, n) | (np.repeat(new, n) & _is_low(hashes))
                h, node, level = hashes[send], np.repeat(nodes, n)[send], np.zeros(int(send.sum()), np.int32)
                if len(keys):
                    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    level = np.where(keys[k] == h, MOST + np.minimum(times[k], 1 << 30), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(level)], ["hash", "node", "level"])

    return texts.mapInArrow(make, SENT)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by hash and node: those of hashes with more than one node, with their number as the
    level. Rows of one hash are held up to MOST; those of a longer one pass with that level."""
    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
    long_hash, last = None, None

    def out(h: np.ndarray, node: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        new = first.copy()
        new[1:] |= node[1:] != node[:-1]
        if long_hash is not None and len(h) and h[0] == long_hash and node[0] == last:
            new[0] = False  # the node's copy has gone before
        group = np.cumsum(first) - 1
        times = np.bincount(group[new], minlength=int(first.sum()))
        if long_hash is not None and len(h) and h[0] == long_hash:
            times[0] = MOST
        times = np.minimum(times, MOST)[group]
        keep = new & ((level > 0) | (times > 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[keep]), pa.array(np.where(level > 0, level, times)[keep].astype(np.int32)), pa.array(h[keep])],
            ["node", "level", "hash"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        h, node, level = (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns, strict=True))
        end = int(np.searchsorted(h, h[-1], "left"))
        if len(h) - end > MOST or h[-1] == long_hash:
            end = len(h)
        if end:
            # a hash of which MOST rows are held, or have gone, is a long one
            if end == len(h) and h[-1] != long_hash:
                begin = int(np.searchsorted(h, h[-1], "left"))
                if begin:
                    yield out(h[:begin], node[:begin], level[:begin])
                h, node, level, end = h[begin:], node[begin:], level[begin:], end - begin
                long_hash, last = h[-1], None
            yield out(h[:end], node[:end], level[:end])
            if h[end - 1] == long_hash:
                last = node[end - 1]
        held = h[end:], node[end:], level[end:]
    if len(held[0]):
        yield out(*held)


ENTRIES = "entry long, node long, n int, lead int, " + ", ".join(f"p{k} long" for k in range(BEFORE))


def _index(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Index entries of the nodes of a partition sorted by node and level; a node's first row has the level -1
    and its sizes."""
    held, enough = None, 200_000
    for b in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
        if held.num_rows < enough:
            continue
        node = held.column(0).to_numpy()
        end = int(np.searchsorted(node, node[-1], "left"))
        enough = 200_000 if end else 2 * held.num_rows
        if end:
            yield _entries(held.slice(0, end), percent)
            held = held.slice(end)
    if held is not None and held.num_rows:
        yield _entries(held, percent)


def _entries(rows: pa.Table, percent: int) -> pa.RecordBatch:
    node, level, hash_ = (rows.column(k).to_numpy() for k in range(3))
    head = level < 0
    sizes = hash_[head]
    nodes, n, low = node[head], sizes >> 32, sizes & 0xFFFFFFFF
    doc, level, h = (np.cumsum(head) - 1)[~head], level[~head], hash_[~head].view(np.uint64)
    doc = doc.astype(np.int64)
    # the order of hashes is the unsigned one
    order = np.lexsort((h, level, doc))
    doc, level, h = doc[order], level[order], h[order]
    lower = _is_low(h)
    both = [(doc[lower], h[lower], level[lower], low, 0)]
    if (whole := low < reach(n, percent)).any():
        every = whole[doc]
        both.append((doc[every], h[every], level[every], n, 1))
    parts = []
    for d, x, y, sent, k in both:
        e_doc, entry, lead = signatures(d, x, y, sent - np.bincount(d, minlength=len(n)), n, percent)
        # entries of the whole space are others than those of the lower part
        parts.append((e_doc, mix(entry ^ _PAIR[0]) if k else entry, lead))
    d, entry, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
    # singles in the order of all shingles, then pairs in that of their hashes: an order of all entries of a space
    order = np.lexsort((entry, lead, np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]), d))
    d, entry, lead = d[order], entry[order], lead[order]
    columns = [entry.view(np.int64), nodes[d], n[d].astype(np.int32), lead.astype(np.int32)]
    for k in range(1, BEFORE + 1):
        earlier = mix(nodes[d].view(np.uint64) * _PAIR[1] + np.uint64(k))  # for none, what no other node has
        same = d[k:] == d[:-k]
        earlier[k:][same] = entry[:-k][same]
        columns.append(earlier.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in ENTRIES.split(", ")])


def ngram_components(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text of fewer words than a shingle is
    one shingle; a text without words, or null, links with nothing and is its own component. Rows with a null
    doc_id get a null component and link nothing. Rows of one doc_id are each taken by their own text.
    """
    scan = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = scratch.keep(_keys(scan, shingle), "keys")
    rows = keys.filter("shingle is null").select("doc_id", "n", "low", "node")
    # below this size only equal sets are as alike as the threshold
    least = next(n for n in range(1, 10_000) if lacking(np.int64(n + 1), percent) > 0)

    linked = scan.filter("doc_id is not null")
    sent = _sent(linked.select("text"), _hot(keys), shingle, least, percent)
    counted = (
        sent.repartition(F.when(F.col("level") == 0, F.col("hash")).otherwise(F.col("node")))
        .sortWithinPartitions("hash", "node")
        .mapInArrow(_counted, "node long, level int, hash long")
    )
    sizes = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") >= least)).groupBy("node").agg(
        F.first("n").alias("n"), F.first("low").alias("low")
    )
    sizes = sizes.select("node", F.lit(-1).alias("level"), (F.shiftleft("n", 32) + F.col("low")).alias("hash"))
    prefixes = counted.union(sizes).repartition("node").sortWithinPartitions("node", "level").mapInArrow(
        lambda batches: _index(batches, percent), ENTRIES
    )
    dealt = _dealt(scratch.keep(prefixes, "entries")).sortWithinPartitions("key", "lead", "n", "node")
    groups = dealt.mapInArrow(lambda batches: _useful(batches, percent), GROUPS)
    # places of an entry's parts interleave
    place = (F.col("place") - 1) * F.col("salts") + F.col("salt") + 1
    groups = scratch.keep(groups.withColumn("place", place).drop("key", "salt", "salts"), "index")
    sets = _indexed_sets(linked, rows, groups, scratch, shingle)

    # each node with the hub that it shares most entries with
    stars = groups.filter("hub is not null").groupBy("node", "hub").agg(F.count("*").alias("c")).groupBy("node").agg(
        F.max_by("hub", F.struct("c", "hub")).alias("hub")
    )
    links = _verified(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")), sets, percent)
    labels, done, hubs = scratch.keep(components(links, scratch), "labels"), 0, HUBS
    apart = groups.drop("hub")
    while True:
        named = apart.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        each = named.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("place").alias("most"))
        still = each.filter((F.col("lo") != F.col("hi")) & (F.col("most") > done + 1)).select("entry")
        named = named.join(still, "entry", "left_semi")
        if not done:
            named = named.join(sets.select("node", *[F.col("map")[k].alias(f"w{k}") for k in range(MAP)]), "node")
        seen = Observation()
        apart = scratch.keep(named.observe(seen, F.count(F.lit(1)).alias("n")), "apart")
        if not seen.get["n"]:
            break
        more = _verified(_across(apart, done, done + hubs, percent), sets, percent)
        # components of the components
        name = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_of"))
        more = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
            F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")
        )
        new = scratch.keep(components(more, scratch), "joined")
        moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select(
            "node", F.coalesce("new", "label").alias("label")
        )
        labels = scratch.keep(moved.unionByName(new.join(labels, "node", "left_anti")), "labels")
        done, hubs = done + hubs, 4 * hubs
    first = rows.filter("doc_id is not null and n > 0").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_id = first.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = first.groupBy("node").agg(F.first("label").alias("label")).join(least_id, "label").select("node", "component_id")
    out = rows.join(by_node, "node", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A line of 64 * MAP bits for every set: whether it has an odd number of the hashes of a place."""
    place = (np.repeat(np.arange(len(at) - 1), np.diff(at)) * (64 * MAP) + ((hashes >> np.uint64(20)) % np.uint64(64 * MAP)).astype(np.int64)).astype(np.int64)
    odd = (np.bincount(place, minlength=(len(at) - 1) * 64 * MAP) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(-1, MAP)


def _indexed_sets(docs: DataFrame, rows: DataFrame, groups: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """(node, hashes, map) of the nodes in groups, from the texts of one document each."""
    nodes = scratch.keep(groups.select("node").distinct(), "nodes")
    ids = (
        rows.filter("doc_id is not null")
        .join(nodes, "node", "left_semi")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
        .select("doc_id")
        .distinct()
    )
    texts = docs.join(ids, "doc_id", "left_semi").select("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in word_runs(b.column(0), NON_SPACE):
                hashes, at = shingle_sets(words, shingle)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                maps = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, MAP * len(at), MAP, dtype=np.int32)), pa.array(_parities(hashes, at).ravel())
                )
                yield pa.RecordBatch.from_arrays([pa.array(_set_keys(hashes, at)), lists, maps], ["node", "hashes", "map"])

    made = texts.mapInArrow(make, "node long, hashes array<long>, map array<long>")
    return scratch.keep(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as alike as the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(x, "a").join(y, "b").withColumn("both", both)
    return joined.filter(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


DEALT = ENTRIES.replace("entry", "key") + ", entry long, salt int, salts int"
GROUPS = DEALT + ", place int, hub long"
#: an entry of more nodes is taken row by row
_AT_ONCE = 2048


def _dealt(entries: DataFrame) -> DataFrame:
    """The entries' rows dealt by ``key``: their entry, or one of its parts (``salt`` of ``salts``) where it is so long
    that it would keep one task busy; at most a thousand entries are."""
    least = max(PART_ROWS, entries.count() // 1000)
    long = entries.groupBy("entry").agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    parts = F.coalesce(F.ceil(F.col("_n") / least), F.lit(1)).cast("int")
    rows = entries.join(F.broadcast(long), "entry", "left").withColumn("salts", parts).drop("_n")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    rows = rows.withColumn("key", F.when(F.col("salts") > 1, F.xxhash64("entry", "salt")).otherwise(F.col("entry")))
    return rows.select([x.split()[0] for x in DEALT.split(", ")]).repartition("key")


def _useful(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition sorted by key and lead that may link with another one of their entry.

    ``place`` counts a key's rows from 1; ``hub`` is the first row before that the node may link with (of a very long
    entry, and of an entry's part, its first row or none). Of such a key only its first row is held, and all rows stay.
    """
    waiting: pa.Table | None = None
    long_key, long_first, long_place = None, None, 0

    def taken(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal long_key, long_first, long_place
        key, node, n, lead = columns[:4]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        whole = (columns[-1][begin] == 1) & (size <= _AT_ONCE)
        if long_key is not None:
            whole &= key[begin] != long_key
        for kind in np.unique(size[whole]):
            at = begin[whole & (size == kind)]
            if kind == 1:
                continue
            step = max(1, (1 << 20) // (kind * kind))
            for i in range(0, len(at), step):
                yield _checked(columns, at[i : i + step, None] + np.arange(kind), percent)
        for a, k in zip(begin[~whole].tolist(), size[~whole].tolist(), strict=True):
            if key[a] != long_key:
                long_key, long_first, long_place = key[a], (node[a], n[a], lead[a]), 0
            r = np.arange(a, a + k)
            ok = may_link(n[r], lead[r], long_first[1], long_first[2], percent) & (node[r] != long_first[0])
            yield _rows(columns, r, long_place + 1 + np.arange(k), np.full(k, long_first[0]), ok)
            long_place += k

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([waiting, t]).combine_chunks() if waiting is not None else t
        if not t.num_rows:
            continue
        columns = [c.to_numpy() for c in t.columns]
        key = columns[0]
        last = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - last > _AT_ONCE or (long_key is not None and key[-1] == long_key):
            last = len(key)  # the key that may go on is a long one: its rows go now
        waiting = t.slice(last)
        if last:
            yield from taken([c[:last] for c in columns])
    if waiting is not None and waiting.num_rows:
        yield from taken([c.to_numpy() for c in waiting.columns])


def _rows(columns: list[np.ndarray], r: np.ndarray, place: np.ndarray, hub: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c[r]) for c in columns), pa.array(place.astype(np.int32)), pa.array(hub, mask=~has)],
        [x.split()[0] for x in GROUPS.split(", ")],
    )


def _checked(columns: list[np.ndarray], rows: np.ndarray, percent: int) -> pa.RecordBatch:
    """Entries of equal size, a line of ``rows`` each: the rows that may link with another one."""
    _, node, n, lead = columns[:4]
    x, y = rows[:, :, None], rows[:, None, :]
    ok = may_link(n[x], lead[x], n[y], lead[y], percent) & (node[x] != node[y])
    before = ok & (np.arange(rows.shape[1])[None, :, None] > np.arange(rows.shape[1])[None, None, :])
    has, first = before.any(axis=2), before.argmax(axis=2)
    keep = ok.any(axis=2)
    hub = np.take_along_axis(node[rows], first, axis=1)
    place = np.broadcast_to(np.arange(1, rows.shape[1] + 1), rows.shape)
    return _rows(columns, rows[keep], place[keep], hub[keep], has[keep])


def _across(apart: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Pairs (a, b) of an entry's nodes that may link and lie in different components, for the entry's hubs at places
    low + 1 to high: a join of many rows to a few, whose long entries adaptive execution splits."""
    rows = apart.filter(F.col("place") > low)
    hubs = rows.filter(F.col("place") <= high)
    hubs = hubs.select("entry", *[F.col(c).alias(f"_{c}") for c in apart.columns if c not in ("entry", "place")])
    most = F.least(F.col("n") - F.col("lead"), F.col("_n") - F.col("_lead"))
    may = (100 * most >= percent * (F.col("n") + F.col("_n") - most)) & (F.col("label") != F.col("_label")) & (
        F.col("node") != F.col("_node")
    )
    for k in range(BEFORE):
        may = may & ~F.col(f"p{k}").isin([F.col(f"_p{j}") for j in range(BEFORE)])
    # linked sets differ in as many shingles as these at most, and their maps in no more places
    differ = F.floor((100 - percent) * (F.col("n") + F.col("_n")) / F.lit(100 + percent))
    places = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"_w{k}"))) for k in range(MAP)), F.lit(0))
    met = rows.join(hubs, "entry").filter(may & (places <= differ))
    return met.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()
