import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import _text as X

from .cases import LOWER, shingle_set

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0bé.|9", max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1 << 20]))
def test_words_and_sets(texts, run):
    sets, counts, firsts = [], [], {}
    for words in X.word_runs(pa.array(texts, pa.string()), run_bytes=run):
        hashes, at = X.shingle_sets(words)
        sets += [set(hashes[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        counts += words.counts.tolist()
        for k in range(words.n_docs):
            own = re.findall(r"[^\x20\x09-\x0D]+", (texts[words.first + k] or "").translate(LOWER))
            for w, h in zip(own, words.hash[words.bounds[k] : words.bounds[k + 1]].tolist(), strict=True):
                assert firsts.setdefault(w, h) == h
    assert len(set(firsts.values())) == len(firsts)
    plain = [shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for a in range(len(texts)):
        for b in range(a):
            assert len(sets[a] & sets[b]) == len(plain[a] & plain[b])


def test_letters_keep_digits():
    w = next(X.word_runs(pa.array(["Ab9-c_d é!"]), X.LETTERS))
    assert w.counts.tolist() == [4]
