import random

import numpy as np
import pytest

from braidwork.llm import embedding_dedup as m

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    top = list(range(len(ids)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(i), find(j)
        top[max(a, b)] = min(a, b)
    return {v: (int(near[i].sum()), ids[find(i)]) for i, v in enumerate(ids)}


def clustered(n, dim, rng):
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            base = np.array(rng.choice(out)[1])
            v = base * rng.choice([1, 3]) + rng.random() * 0.25 * np.linalg.norm(base) / dim**0.5 * np.array([rng.gauss(0, 1) for _ in range(dim)])
            v = base if rng.random() < 0.2 else v
        else:
            v = np.array([rng.gauss(0, 1) for _ in range(dim)])
        out.append((i, [float(np.float32(c)) for c in v], rng.randrange(2)))
    return sorted(out)


@pytest.mark.parametrize(("block", "n", "dim"), [(1024, 1500, 64), (8, 600, 64), (1024, 300, 5)])
def test_recall_and_precision(spark, block, n, dim):
    rows = clustered(n, dim, random.Random(n + dim))
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in m.near_duplicates(spark.createDataFrame(rows, KIND), block=block).collect()}
    assert got.keys() == want.keys()
    assert all(got[v][0] <= want[v][0] for v in want)
    assert sum(v for v, _ in got.values()) >= 0.97 * sum(v for v, _ in want.values()) > 0
    assert sum(got[v][1] == want[v][1] for v in want) >= 0.97 * len(want)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [1.0, inf], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1),
            (10, [1.0, 0.0, 0.0], 1), (11, [1.0, -0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [1e-30, 0.0], 1), (13, [1e-30, 0.0], 1), (14, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as rep", "2 as links", "3 as dim")
    got = m.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    for v in (1, 2, 3, 4, 5, 6, 7, 10, 12, 14):
        assert by[v] == (0, v, True)
    assert by[None] == (0, None, True)
    assert by[8] == (4, 8, True) and by[9] == by[11] == by[13] == (4, 8, False)
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_rotation_is_orthogonal():
    x = m.unit(np.random.default_rng(0).standard_normal((500, 16)))
    _, p = m.learn_rotation(x, 16)
    assert np.allclose(p.T @ p, np.eye(16))


def pairs_at(cosine, n, dim, rng):
    """Unit vectors and others at about that cosine to them."""
    x = m.unit(rng.standard_normal((n, dim)))
    y = rng.standard_normal((n, dim))
    y = m.unit(y - (y * x).sum(1, keepdims=True) * x)
    return x, cosine * x + (1 - cosine**2) ** 0.5 * y


@pytest.mark.parametrize("vectors", [100, 10_000, 60_000, 250_000, 1_000_000, 10**9])
def test_recall_of_every_layout(vectors):
    """Pairs from 0.98 to 0.985, the hardest that count, meet in a table of every layout and are accepted."""
    rng = np.random.default_rng(vectors % 97)
    x, y = (np.concatenate(z) for z in zip(*(pairs_at(c, 1500, 64, rng) for c in (0.98, 0.985)), strict=True))
    mean, projection = m.learn_rotation(np.concatenate([x, y])[::2], 64)
    differ = m.encode(x, mean, projection) ^ m.encode(y, mean, projection)
    chunks, near = m.layout(64, vectors, m.RADIUS)
    meets = np.zeros(len(x), bool)
    for shift, width in chunks:
        meets |= np.bitwise_count(differ >> np.uint64(shift) & np.uint64((1 << width) - 1)) <= near
    found = meets & (np.bitwise_count(differ) <= m.ACCEPT)
    assert found.mean() >= 0.95


def test_doubles_beyond_floats_and_labels_of_any_type(spark):
    rows = [(1, [1e300, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [1e-60, 0.0], "a"), (4, [1.0, 0.0], "b"), (5, [1.0, 1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in m.near_duplicates(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
    dates = df.selectExpr("vec_id", "embedding", "date_add(date '2020-01-01', ascii(label)) as label")
    assert {r.vec_id: r.n_links for r in m.near_duplicates(dates).collect()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0}


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [0.0, 1.0, 0.01], 1), (3, [0.0, 0.0, 1.0], 1)]
    got = sorted((r.vec_id, r.component_id) for r in m.near_duplicates(spark.createDataFrame(rows, KIND)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
