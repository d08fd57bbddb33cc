import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import words as w
from braidwork.llm.components import components


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\t\n é  \x0b\x1c", max_size=30)), max_size=6))
def test_words_are_those_of_bytes_split(texts):
    got = w.Words(pa.array(texts, pa.string()))
    found = [[got.bytes_of(got.start[i], got.end[i]) for i in range(got.first[r], got.first[r + 1])] for r in range(len(texts))]
    assert found == [(t or "").encode().split() for t in texts]


def test_hash_depends_on_the_word_alone():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["z" * (w.SPAN + 5)]
    texts = [" ".join(rng.choice(vocabulary[:-1]) for _ in range(500)) for _ in range(5)] + [vocabulary[-1] + " a " + vocabulary[-1]]
    got = w.Words(pa.array(texts))
    seen = {}
    for i, h in enumerate(got.hashes().tolist()):
        assert seen.setdefault(got.bytes_of(got.start[i], got.end[i]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_every_row_once():
    batch = pa.record_batch([pa.array(range(50)), pa.array(["x" * (i % 7) * 10 for i in range(50)])], names=["doc_id", "text"])
    parts = list(w.slices(iter([batch, batch.slice(3, 9), batch.slice(0, 0)]), limit=100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(50), *range(3, 12)]
    for p in parts:
        x = w.Words(p.column(1))
        assert np.diff(x.first).tolist() == [int(bool(t)) for t in p.column(1).to_pylist()]


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)] + [(7, None), (8, 8)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
