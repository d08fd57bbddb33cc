import random

import numpy as np
import pytest

from braidwork.llm import simhash_similarity as m


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(texts):
    """doc_id -> smallest doc_id reachable by similarities of 0.8 or more."""
    sets, top = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and jaccard(sets[i], sets[j]) >= 0.8:
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def near(documents):
    """Documents and copies of some with a few words changed."""
    rng, texts = random.Random(3), {r.doc_id: r.text for r in documents.collect()}
    base = [t for t in texts.values() if t and 60 <= len(t.split()) <= 400][:25]
    for k in range(150):
        words = rng.choice(base).split()
        for at in rng.sample(range(len(words)), rng.randrange(1, 2 + len(words) // 40)):
            words[at] = f"new{rng.randrange(9)}"
        texts[1_000_000 + k] = " ".join(words)
    return texts


def linked(groups):
    """The pairs of documents of one group."""
    by = {}
    for i, c in groups.items():
        by.setdefault(c, []).append(i)
    return {(a, b) for own in by.values() for a in own for b in own if a < b}


@pytest.mark.parametrize(("limit", "cells"), [(500, 20), (m.CLUSTER_LIMIT, 1 << 16)])
def test_groups_against_brute_force(spark, near, limit, cells):
    df = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    want = linked(brute(near))
    got = linked({r.doc_id: r.component_id for r in m.groups(df, limit=limit, cell_limit=cells).collect()})
    assert got <= want and len(got) >= 0.97 * len(want)
    assert len(want) > 80


def test_recall_just_above_the_threshold(spark):
    """Pairs of texts with a similarity from 0.8 to 0.83, which are the hardest to find."""
    rng, texts = random.Random(8), {}
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 300))]
        other = list(words)
        for _ in range(200):
            trial = list(other)
            trial[rng.randrange(len(trial))] = "new"
            if jaccard(shingles(" ".join(words)), shingles(" ".join(trial))) < 0.8:
                break
            other = trial
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(other)
    close = [k for k in range(150) if jaccard(shingles(texts[2 * k]), shingles(texts[2 * k + 1])) < 0.83]
    got = {r.doc_id: r.component_id for r in m.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(close) > 100
    assert sum(got[2 * k + 1] == 2 * k for k in close) >= 0.93 * len(close)


def test_fingerprints_against_counting():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 255, 256, 700)]
    first = np.cumsum([0, *(len(x) for x in sets)])
    got = m.fingerprints(np.concatenate(sets), first)
    for row, own in zip(got, sets, strict=True):
        for k, salt in enumerate(m._SALT):
            h = m.mix(own ^ salt)
            assert int(row[k]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(own))


def test_rounds_one_by_one(spark, near, monkeypatch):
    """How many rounds are one job changes no result."""
    df = spark.createDataFrame([(i, t) for i, t in near.items() if i % 5 == 0], "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in m.groups(df).collect()}
    monkeypatch.setattr(m, "VISITS", 4 * 50 * len(want))
    assert {r.doc_id: r.component_id for r in m.groups(df).collect()} == want


def test_a_large_group_is_not_spanned_in_every_round(spark, monkeypatch):
    """What is exploded and linked does not grow with the number of jobs or rounds."""
    rng, texts = random.Random(5), {}
    base = [f"w{i}" for i in range(150)]
    for k in range(300):
        words = list(base)
        words[rng.randrange(150)] = f"new{k}"
        texts[k] = " ".join(words)
    exploded, linked = [], []
    every_of, components = m.every_of, m.components

    def explode(*args, **kwargs):
        rows = every_of(*args, **kwargs)
        exploded.append(rows.count())
        return rows

    def connect(edges):
        linked.append(edges.where("a <> b").distinct().count())
        return components(edges)

    monkeypatch.setattr(m, "every_of", explode)
    monkeypatch.setattr(m, "components", connect)
    monkeypatch.setattr(m, "VISITS", 50 * len(texts))  # every round is a job of its own
    got = {r.doc_id: r.component_id for r in m.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}
    assert sum(exploded) == 2 * m.ROUNDS * len(texts)  # once to count cells, once to search
    assert sum(linked) <= 20 * len(texts)


def test_odd_rows(odd, empty):
    assert sorted(r.doc_id for r in m.representatives(odd).where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 10]
    assert m.representatives(odd).where("doc_id is null").count() == 2
    assert m.representatives(empty).count() == 0
