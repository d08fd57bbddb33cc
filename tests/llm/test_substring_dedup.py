import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from braidwork.llm import substring_dedup as m


def brute(rows, width=20):
    seen, out = {}, {}
    for doc, text in sorted((d, t or "") for d, t in rows if d is not None):
        words = text.encode().split()
        gone = set()
        for i in range(len(words) - width + 1):
            first = seen.setdefault(tuple(words[i:i + width]), (doc, i))
            if first != (doc, i):
                gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize("limit", [2, 2000])
def test_matches_brute_force(spark, documents, limit):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(m.dedup_substrings(documents, group_limit=limit)) == brute(rows)


@pytest.mark.parametrize("limit", [3, 2000])
def test_overlapping_repeats(spark, limit):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdef") + rng.choice("xy") for _ in range(rng.randrange(15, 60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("pqrst") for _ in range(9)) for _ in range(rng.randrange(6)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(m.dedup_substrings(df, group_limit=limit)) == brute(rows)


def test_odd_rows(odd):
    rows = {(r.doc_id, r.text): r for r in odd.collect()}
    assert result(m.dedup_substrings(odd)) == brute([k for k in rows])
    assert m.dedup_substrings(odd).count() == odd.count()


def test_null_ids_are_not_judged(odd):
    got = [r for r in m.dedup_substrings(odd).collect() if r.doc_id is None]
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (5, 0)]


def test_empty(empty):
    assert m.dedup_substrings(empty).count() == 0


def test_rewrite_keeps_columns(documents):
    out = m.rewrite_documents(documents)
    assert out.columns == documents.columns
    assert out.count() == documents.count()


def plain_repeats(segments, places, n, width):
    """For each suffix the longest prefix of at least `width` words that a suffix at a smaller place has as well."""
    suffixes = sorted((doc, start + j, seg.split()[j:], i, j) for i, (seg, (doc, start)) in enumerate(zip(segments, places, strict=True)) for j in range(n[i]))
    out = {}
    for k, (_, _, words, i, j) in enumerate(suffixes):
        best = 0
        for _, _, other, _, _ in suffixes[:k]:
            same = next((x for x, (a, b) in enumerate(zip(words, other, strict=False)) if a != b), min(len(words), len(other)))
            best = max(best, same)
        if best >= width:
            out[i, j] = best
    return {k: v for k, v in out.items() if out.get((k[0], k[1] - 1), 0) <= v}


@pytest.mark.parametrize("width", [2, 3, 5, 8])
def test_maximal_repeats_against_all_pairs(width):
    rng = random.Random(width)
    for _ in range(30):
        segments = [b"".join(rng.choice([b"a ", b"b ", b"cc "]) for _ in range(rng.randrange(width, width + 6))) for _ in range(rng.randrange(1, 12))]
        places = [(k // 3, 100 * k) for k in rng.sample(range(20), len(segments))]
        n = [rng.randrange(1, len(s.split()) - width + 2) for s in segments]
        row, offset, depth = m.maximal_repeats(pa.array(segments, pa.binary()), *(np.array(x, np.int64) for x in zip(*places, strict=True)), np.array(n), width)
        assert {(a, b): c for a, b, c in zip(row.tolist(), offset.tolist(), depth.tolist(), strict=True)} == plain_repeats(segments, places, n, width)


def test_groups_that_span_batches():
    """Whole groups meet whatever the batches and however little is held at a time."""
    rng = random.Random(5)
    rows = sorted((k, rng.randrange(50), 100 * i, 1, b"a b c d " + rng.choice([b"e ", b"f "])) for i, k in enumerate(rng.choices(range(12), k=200)))
    batch = pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()))], names=["key", "doc_id", "start", "n", "seg"])
    # groups differ in words too, as they do in use
    batch = batch.set_column(4, "seg", pa.array([b"k%d " % r[0] + r[4] for r in rows], pa.binary()))

    def found(size, held):
        parts = [batch.slice(i, size) for i in range(0, len(rows), size)]
        return sorted(tuple(x.values()) for b in m._subtrees(4, held)(iter(parts)) for x in b.to_pylist())

    want = found(len(rows), 1 << 20)
    assert len(want) > 100
    assert all(found(size, held) == want for size in (1, 7, 60) for held in (1, 300, 1 << 20))
