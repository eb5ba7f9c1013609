import gzip
import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import chat_tree as C
from barloom.llm import warc as W

from . import cases


def pages(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [
        (1, "http://a", big),
        (2, "http://b c", big),
        (3, None, big),
        (4, "u", "short"),
        (5, "u", "short"),
        (6, "u", None),
        (7, "u", ""),
        (8, "u", other),
        (8, "u", other),
        (None, "u", other),
        (None, None, "y" * 2000),
        (9, "u", "q" * 999),
        (10, "u", "q" * 999),
        (11, "u", "r\r\n\r\nWARC/1.1 " * 200),
    ]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n int, payload_digest string")


def test_revisits(spark):
    files = W.deduplicated_archives(pages(spark), cases.scratch(spark))
    records = W.with_payload_bytes(W.read_archives(spark, files, payloads=True)).collect()
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in records)
    plain = []
    rows = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    for i, body in rows:
        same = [j for j, b in rows if b == body and j is not None]
        to = max(same) if len(body) >= 1000 and len([1 for _, b in rows if b == body]) > 1 and same else None
        plain.append(
            (str(i), "response" if to is None or to == i else "revisit", None if to == i else to, len(body), hashlib.sha1(body).hexdigest())
        )
    assert got == sorted(plain)
    assert sorted(r.html or "" for r in records if r.record_type == "response") == sorted(
        b.decode() for (_, b), p in zip(rows, plain, strict=True) if p[1] == "response"
    )
    path = files.first().file.removeprefix("file://")
    with open(path, "rb") as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def test_archives_that_hold_revisits(spark):
    """Written again, every record has the payload that it had, also where a revisit has the larger id."""
    big, small = "é" * 700, "short"
    rows = [(1, "a", big, None), (2, "b", big, 1), (3, "c", big, 1), (4, "d", small, None), (5, "e", small, 4), (6, "f", "z" * 3000, None)]
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    scratch = cases.scratch(spark)
    old = spark.createDataFrame(
        [(p, u, digest(t), t, to) for p, u, t, to in rows], "page_id long, url string, payload_digest string, html string, refers_to long"
    )
    files = scratch.keep(W.write_archives(old, scratch.path("old")), "files")
    again = W.rewritten_archives(W.read_archives(spark, files, payloads=True), scratch)
    got = {r.page_id: r for r in W.with_payload_bytes(W.read_archives(spark, again, payloads=True)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None)
    }
    assert {i: r.html for i, r in got.items() if r.record_type == "response"} == {1: big, 4: small, 5: small, 6: "z" * 3000}
    assert all(r.payload_digest == digest(t) and r.payload_bytes == len(t.encode()) for (i, _, t, _), r in ((x, got[x[0]]) for x in rows))


def test_long_payloads_and_several_files(spark, monkeypatch):
    """Members of more than one read, and archives that roll over."""
    monkeypatch.setattr(W, "FILE_BYTES", 1000)
    import random

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(3_000_000)), "q" * 2_500_000, *(f"page {i} " * 200 for i in range(30))]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    body = W.payload_headers(df)
    records = df.join(body, "page_id").withColumn("refers_to", F.lit(None).cast("long"))
    scratch = cases.scratch(spark)
    written = scratch.keep(W.write_archives(records, scratch.path("archives")), "files").collect()
    assert sum(r.records for r in written) == 32 and len({r.file for r in written}) == len(written) >= 1
    files = spark.createDataFrame([(r.file,) for r in written], "file string")
    got = {r.page_id: r.html for r in W.read_archives(spark, files, payloads=True).collect()}
    assert got == dict(enumerate(texts))


def test_no_pages(spark):
    empty = pages(spark).filter("page_id > 100")
    files = W.deduplicated_archives(empty, cases.scratch(spark))
    assert W.with_payload_bytes(W.read_archives(spark, files)).count() == 0


TEXT = st.text(alphabet="ab<|\\n\n>im_", max_size=25) | st.sampled_from(
    [C.BEGIN, C.END, C.END + C.BEGIN + "assistant ok", "\\", "<", "\\n"]
)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_template_round_trip(turns):
    assert C.parse("".join(C.segment(r, t)[0] for r, t in turns)) == turns


def conversations(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "user", "hi"),
        (1, 2, "assistant", "hello"),
        (2, 1, "user", "hi"),
        (2, 0, "system", "be kind"),
        (2, 2, "assistant", "what?"),
        (3, 0, "system", "be kind"),
        (3, 1, "user", "hi"),
        (3, 2, "assistant", "hello"),
        (4, 0, "user", None),
        (4, 1, None, "x"),
        (4, None, "assistant", C.END + "\\<|"),
        (5, 0, "assistant", "twice"),
        (5, 0, "assistant", "twice"),
        (None, 0, "user", "lost"),
        (None, 0, "user", "lost"),
        (None, 1, "user", "too"),
        (6, 0, "us\ner", "é🙂\n"),
    ]
    return spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, path int")


def test_tree(spark):
    df = conversations(spark)
    segments, leaves = C.build(df, cases.scratch(spark))
    every = C.read_back(segments, leaves).collect()
    assert sorted((r.n_turns, r.formatted_chars) for r in every if r.conv_id is None) == sorted(
        (1, len(C.segment("user", t)[0])) for t in ("lost", "lost", "too")
    )
    got = {r.conv_id: r for r in every if r.conv_id is not None}
    assert len(every) == len(got) + 3
    by_conv = {}
    for r in df.filter("conv_id is not null").collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    assert got.keys() == by_conv.keys()
    for i, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(C.segment(r, t)[0] for r, t in turns)
        assert (got[i].n_turns, got[i].formatted_chars, got[i].loss_chars) == (len(turns), len(whole), len(loss))
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    rows = segments.orderBy("start").collect()
    at = 0
    for r in rows:  # one gapless row of tokens, each node after its ancestors
        assert r.start == at and len(r.tokens) == r.length
        at += r.length
        covered = sum(b - a for a, b in r.intervals)
        assert r.intervals[-1][1] == r.start + r.length and r.position + r.length == covered
        assert C.position_ids(r.position, r.length)[:1] == [r.position]
    starts = {r.node: r for r in rows}
    tokens = "".join(r.tokens for r in rows)
    for r in rows:  # the intervals are the tokens of the way from the root
        way, x = "", r
        while x:
            way, x = x.tokens + way, starts.get(x.parent)
        assert "".join(tokens[a:b] for a, b in r.intervals) == way
    assert sum("be kind" in r.tokens for r in rows) == 1
    assert len(rows) == len({r.node for r in rows})
    assert C.read_back(*C.build(df.filter("conv_id > 99"), cases.scratch(spark))).count() == 0


def test_tree_of_token_ids(spark):
    """Lengths, positions and intervals in ids of a public tokenizer; the learnt ids are the assistant's text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    long = "many words, " * 200_000
    df = conversations(spark).union(
        spark.createDataFrame(
            [(7, 0, "user", long, "n", 1), (7, 1, "assistant", long + "é", "n", 1)],
            "conv_id long, turn long, role string, text string, node string, path int",
        )
    )
    segments, leaves = C.build(df, cases.scratch(spark), tokenizer=path)
    rows = segments.orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at and r.length == len(r.ids) and library.decode(r.ids, skip_special_tokens=False) == r.tokens
        at += r.length
        assert r.position + r.length == sum(b - a for a, b in r.intervals)
        if r.loss_from is not None:
            assert library.decode(r.ids[r.learnt_from : r.learnt_to], skip_special_tokens=False) == r.tokens[r.loss_from : r.loss_to]
        else:
            assert r.learnt_from is None
    plain = {r.conv_id: r for r in C.read_back(*C.build(df, cases.scratch(spark))).collect() if r.conv_id is not None}
    assert {r.conv_id: r for r in C.read_back(segments, leaves).collect() if r.conv_id is not None} == plain


def test_long_and_forked(spark, monkeypatch):
    rows = []
    for c in range(12):  # forks at turn 10 * c of a long one
        for t in range(150):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t}" if t < 10 * c else f"turn {t} of {c}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, leaves = C.build(df, cases.scratch(spark))
    assert segments.count() == len({tuple(x[3] for x in rows if x[0] == c and x[1] <= t) for c in range(12) for t in range(150)})
    got = {r.conv_id: r for r in C.read_back(segments, leaves).collect()}
    for c in range(12):
        said = "".join(f"{r}\n{t}\n" for k, _, r, t in rows if k == c)
        assert got[c].n_turns == 150 and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
