import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import ngram_join as J
from barloom.llm._text import mix
from barloom.llm.components import components

from . import cases


def check(spark, docs):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    got = {}
    for r in J.ngram_components(docs, cases.scratch(spark)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    sets = {r.doc_id: cases.shingle_set(r.text) for r in rows if r.doc_id is not None}
    want = cases.groups(sets)
    assert {k: v for k, v in got.items() if k is not None} == {i: {(len(s), want[i])} for i, s in sets.items()}
    assert J.ngram_components(docs, cases.scratch(spark)).count() == len(rows)
    assert all(c is None for _, c in got.get(None, ()))


def test_against_all_pairs(spark):
    check(spark, cases.documents(spark))


def test_chains_and_one_large_family(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):  # copies of one text, some too far from it
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        texts.append(" ".join(w))
    for i in range(30):  # each like the next one only
        texts.append(" ".join(f"c{j}" for j in range(2 * i, 2 * i + 60)))
    rnd.shuffle(texts)
    check(spark, spark.createDataFrame([cases.row(i, t) for i, t in enumerate(texts)], cases.SCHEMA).repartition(7))


def test_empty(spark):
    assert J.ngram_components(cases.empty(spark), cases.scratch(spark)).count() == 0


def sent(node, hashes, level):
    """What _index reads of a node whose shingles have these levels (0: in no other node)."""
    import pyarrow as pa

    low = J._is_low(hashes)
    whole = low.sum() < J.reach(np.array([len(hashes)]))[0]
    rows = [(node, -1, len(hashes) << 32 | int(low.sum()))]
    rows += sorted((node, int(v), int(h)) for h, v, lo in zip(hashes.view(np.int64), level, low, strict=True) if (lo or whole) and v)
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)],
        ["node", "level", "hash"],
    )


@settings(max_examples=400, deadline=None)
@given(st.integers(4, 160), st.integers(0, 40), st.integers(0, 40), st.integers(0, 6), st.integers(0, 3))
def test_linked_sets_share_an_entry_that_they_may_link_by(n, only_x, only_y, seed, kind):
    """Whatever the levels, two sets as alike as the threshold meet, and the bound lets them pass."""
    import pyarrow as pa

    rnd = np.random.default_rng(seed * 1000 + n)
    pool = mix(rnd.integers(0, 1 << 62, n + only_x + only_y, dtype=np.uint64))
    if 100 * n < 80 * (n + only_x + only_y):
        return
    levels = rnd.choice([[2, 3], [2, 30, 40, 5000, J.MOST + 9], [33, 40, J.MOST], [0, 2, 33]][kind], len(pool))
    levels[:n] = np.maximum(levels[:n], 2)  # a shingle of both is in two nodes
    parts = [slice(0, n + only_x), np.r_[0:n, n + only_x : len(pool)]]
    batches = [b for k, part in enumerate(parts) for b in sent(k, pool[part], levels[part]).to_batches()]
    of, before = [{}, {}], [{}, {}]
    for b in J._index(iter(batches), 80):
        for r in b.to_pylist():
            of[r["node"]][r["entry"]] = (r["n"], r["lead"])
            before[r["node"]][r["entry"]] = {r[f"p{i}"] for i in range(J.BEFORE)}
    # and at one of the entries that they meet at no entry of both comes just before
    both = [k for k in of[0].keys() & of[1].keys() if not before[0][k] & before[1][k]]
    assert any(J.may_link(*(np.int64(v) for x in of for v in x[k])) for k in both)
    # their bit maps pass as well
    sets = [np.sort(pool[part]) for part in parts]
    a, b = J._parities(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= 20 * (len(sets[0]) + len(sets[1])) // 180


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_counts_of_nodes(monkeypatch, most):
    import pyarrow as pa

    monkeypatch.setattr(J, "MOST", most)
    rnd = random.Random(5)
    rows = sorted((h, rnd.randrange(40), 0) for h in range(30) for _ in range(rnd.choice([1, 2, 3, 9, 30])))
    rows += [(100, 7, most + 5), (100, 7, most + 5), (101, 1, most + 6)]
    nodes = {}
    for h, node, _ in rows:
        nodes.setdefault(h, set()).add(node)
    want = {(h, node): min(len(x), most) if h < 100 else most + h - 95 for h, x in nodes.items() for node in x if len(x) > 1 or h >= 100}
    for size in (1, 2, 7, len(rows)):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows[i : i + size], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)],
                ["hash", "node", "level"],
            )
            for i in range(0, len(rows), size)
        ]
        got = [((r["hash"], r["node"]), r["level"]) for b in J._counted(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(dict(got))
        if most > 30:
            assert dict(got) == want
        else:  # the rows of a long one go with the greatest level, a repeated one may count before that is known
            assert {k: v for k, v in got if v > 1 or k[0] >= 100}.keys() >= want.keys()


def test_frequent_and_hot_shingles(spark, monkeypatch):
    """Boilerplate in most documents, and families in it."""
    rnd = random.Random(8)
    shared = " ".join(f"b{i}" for i in range(60))
    families = [[f"f{k}x{i}" for i in range(90)] for k in range(3)]
    texts = []
    for i in range(240):
        w = list(families[i % 3]) if i < 150 else [f"u{i}x{j}" for j in range(rnd.choice([5, 20, 60]))]
        for _ in range(rnd.randint(0, 8) if i < 150 else 0):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(500)}"
        texts.append(" ".join(w) + " " + shared if i % 2 else shared + " " + " ".join(w))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([cases.row(i, t) for i, t in enumerate(texts)], cases.SCHEMA).repartition(5)
    check(spark, docs)
    keys = J._keys(docs.select("doc_id", "text"), 5)
    hot = J._hot(keys)[0]
    assert 50 <= len(hot) <= 600 and (np.diff(hot.astype(object)) > 0).all()


def test_long_entries_go_row_by_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(J, "_AT_ONCE", 4)
    entry = np.array([1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 4, 4, 5])
    node, n, lead = np.arange(13) + 100, np.full(13, 50, np.int32), np.zeros(13, np.int32)
    one = np.ones(13, np.int32)
    columns = [entry, node, n, lead, *[node] * J.BEFORE, entry, one - 1, one]
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in J.DEALT.split(", ")])
    for size in (1, 2, 3, 5, 13):
        out = [r for b in J._useful((rows.slice(i, size) for i in range(0, 13, size)), 80) for r in b.to_pylist()]
        assert sorted((r["entry"], r["node"]) for r in out if r["entry"] != 3) == [(2, 101), (2, 102), (4, 110), (4, 111)]
        assert sorted(r["node"] for r in out if r["entry"] == 3) == list(range(103, 110))
        assert {r["hub"] for r in out if r["entry"] == 3} <= {None, 103}


def test_entries_in_parts(spark, monkeypatch):
    """Every entry of more than three rows meets in parts: all links are found, and no part loses a row."""
    monkeypatch.setattr(J, "PART_ROWS", 3)
    test_chains_and_one_large_family(spark)
    rows = [(e, node, 50, 0, *[node] * J.BEFORE) for e, k in ((1, 2), (2, 3), (3, 40)) for node in range(k)]
    dealt = J._dealt(spark.createDataFrame(rows, J.ENTRIES))
    got = [(r.entry, r.node, r.salts, r.key, r.salt) for r in dealt.collect()]
    assert sorted((e, node) for e, node, *_ in got) == [(e, node) for e, node, *_ in rows]
    assert {e: s for e, _, s, _, _ in got} == {1: 1, 2: 1, 3: 14} and len({k for *_, k, _ in got}) > 10
    useful = dealt.sortWithinPartitions("key", "lead", "n", "node").mapInArrow(lambda b: J._useful(b, 80), J.GROUPS).collect()
    assert sorted(r.node for r in useful if r.entry == 3) == list(range(40))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [
        (500, k) for k in range(501, 540)
    ]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), cases.scratch(spark)).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), cases.scratch(spark)).count() == 0
