"""The stages on small tables, against plain versions of each."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import bpe, stages

from . import cases
from .test_documents import PRIVATE, plain_contamination


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    good = [cases.row(i, r.text) for i, r in enumerate(cases.documents(spark).collect()) if r.text and 100 < len(r.text) < 10_000]
    bad = [cases.row(1000 + r[0], r[1].upper().replace(" ", "!! ")) for r in good]
    item = " ".join(good[3][1].split()[:20])
    rows = [
        *good,
        *bad,
        *(cases.row(5000 + i, t + " " + good[5][1]) for i, t in PRIVATE),
        cases.row(6000, f"{item} {item}"),
        cases.row(None, good[0][1]),
    ]
    # columns of names that the stages use themselves
    schema = cases.SCHEMA + ", predicted int, n_entities long, component_id long, _text string, _x string"
    spark.createDataFrame([(*r, 7, 8, 9, "t", "x") for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, items = docs.columns, [(1, spark.read.parquet(f"{folder}/benchmark.parquet").first().text)]
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stages.Scratch(spark, "t").keep(stage(spark, docs, folder), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        found[name] = after
        ids = {r.doc_id for r in before}
        if name == "quality classifier":
            assert after.keys() == {i for i in ids if i is None or not 1000 <= i < 5000}
        elif name == "n-gram Jaccard join":
            want = cases.groups({r.doc_id: cases.shingle_set(r.text) for r in before if r.doc_id is not None})
            assert after.keys() - {None} == {i for i, c in want.items() if i == c} and None in after
        elif name == "benchmark decontamination":
            for r in before:
                n, hit, _ = plain_contamination(r.text, items)
                assert (r.doc_id in after) == (not (hit > 0 and 20 * hit >= n))
        elif name == "PII":
            assert after.keys() == ids and all(r.n_chars == len(r.text) for r in after.values())
            assert not any("555-2485" in r.text or "4041894974608795" in r.text for r in after.values())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert {(r.node, r.score, r.path, r.n, r.predicted, r.n_entities, r.component_id, r["_text"], r["_x"]) for r in after.values()} == {(1, 0.5, "p", 2, 7, 8, 9, "t", "x")}
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    for i, r in found["BPE encoding and decoding"].items():
        ids = library.encode(found["PII"][i].text, add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(map(str, found["PII"]))


def test_empty_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = -5")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
