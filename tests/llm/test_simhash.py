import random

import numpy as np
import xxhash

from braidwork.llm import simhash as m


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, distance):
    """doc_id -> smallest reachable doc_id."""
    ids, top = sorted(fps), {i: i for i in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_matches_brute_force(documents):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in documents.collect()}
    want = brute(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in m.near_duplicates(documents).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_chains_of_close_fingerprints(spark):
    rng = random.Random(5)
    fps = {}
    for i in range(400):
        base = rng.choice(list(fps.values())) if fps and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            base ^= 1 << rng.randrange(64)
        fps[i] = base
    for distance in (0, 1, 3, 4, 5):
        df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in fps.items()], "doc_id long, fp long")
        want = brute(fps, distance)
        for limit in (3, 1 << 16):
            groups = {r.fp: r.component_id for r in m.fingerprint_groups(df, distance, limit).collect()}
            assert {i: groups[int(np.uint64(f).astype(np.int64))] for i, f in fps.items()} == want


def test_cells_of_linked_fingerprints_meet():
    rng = random.Random(9)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        index, cell = m.cells(np.array([a, b], np.uint64), 4)
        assert set(cell[index == 0].tolist()) & set(cell[index == 1].tolist())


def test_crowded_cells_are_split(spark):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(300)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").selectExpr("fp", "0 as grid")
    found = {r.cell: r.blocks for r in m.crowded(df, 4, 20).collect()}
    visits = {}
    index, to = m.cells(np.array(fps, np.uint64), 4)
    for c in to.tolist():
        visits[c] = visits.get(c, 0) + 1
    assert found and {c for c, n in visits.items() if n > 40} <= set(found) <= {c for c, n in visits.items() if n > 20}
    assert min(found.values()) >= 4


def test_odd_rows(odd):
    got = m.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[7].component_id == by[8].component_id == 7


def test_representatives(odd, documents):
    assert sorted(r.doc_id for r in m.representatives(odd).where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 10]
    assert m.representatives(documents).columns == documents.columns


def test_empty(empty):
    assert m.near_duplicates(empty).count() == 0
