import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from braidwork.llm import lm_scoring as m
from braidwork.llm.words import Words


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def plain_base(rows):
    c = Counter()
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 5 != 1:
            c.update(tokens(text))
    n, v = sum(c.values()), len(c)
    return [(doc, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for doc, t in rows]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("hot", [20, 1 << 18])
def test_base_matches_brute_force(documents, hot):
    want = plain_base([(r.doc_id, r.text) for r in documents.collect()])
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in m.score(documents, hot=hot, nodes=1 << 20).collect()]
    assert order(got) == order(want)


class PlainTree:
    """Recursive context-tree weighting over dictionaries."""

    def __init__(self, streams, depth):
        self.depth, self.count = depth, defaultdict(lambda: [0, 0])
        for s in streams:
            padded = bytes(depth) + s
            for i in range(depth, len(padded)):
                for bit in range(8):
                    for d in range(depth + 1):
                        self.count[padded[i - d:i], bit, padded[i] >> (8 - bit)][padded[i] >> (7 - bit) & 1] += 1
        self.children = defaultdict(list)
        for context, bit, prefix in self.count:
            if context:
                self.children[context[1:], bit, prefix].append((context, bit, prefix))
        self.memo = {}

    def weights(self, node):
        if node not in self.memo:
            n0, n1 = self.count[node]
            kt = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
            if len(node[0]) == self.depth:
                self.memo[node] = (kt, 1.0)
            else:
                below = sum(self.weights(x)[0] for x in self.children[node])
                total = np.logaddexp(kt, below) + math.log(0.5)
                self.memo[node] = (total, math.exp(kt + math.log(0.5) - total))
        return self.memo[node]

    def probability(self, context, bit, prefix):
        node = (context, bit, prefix)
        n0, n1 = self.count[node]
        p = (n1 + 0.5) / (n0 + n1 + 1)
        return p, self.weights(node)[1]

    def log10(self, s):
        padded, total = bytes(self.depth) + s, 0.0
        for i in range(self.depth, len(padded)):
            for bit in range(8):
                rest, mixed, last = 1.0, 0.0, 0.5
                for d in range(self.depth + 1):
                    node = (padded[i - d:i], bit, padded[i] >> (8 - bit))
                    if node not in self.count:
                        break
                    last, w = self.probability(*node)
                    mixed += rest * w * last
                    rest *= 1 - w
                mixed += rest * last
                total += math.log10(mixed if padded[i] >> (7 - bit) & 1 else 1 - mixed)
        return total


def stream(text):
    return b"".join(w + b" " for w in text.encode().lower().split()) + b" "


def whole_tree(streams, depth, top):
    """All levels of the distributed tree, put together in one place."""
    key, count = np.unique(np.concatenate(streams), return_counts=True) if streams else (np.empty(0, np.uint64), np.empty(0, int))
    shards = m.shard_levels(key, count, depth, top)
    return m.top_levels(*shards[top + 1].shorter(), top) | shards if shards else {}


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_levels_match_a_recursive_tree(depth):
    learn = ["the cat sat on the mat", "The dog sat", "a cat, a dog and a mat " * 3, ""]
    new = ["the cat", "zebra mat on", "", "THE DOG and the Mat"]
    plain = PlainTree([stream(t) for t in learn], depth)
    levels = whole_tree([m.byte_stream(Words(pa.array(learn)), depth)[0]], depth, min(m.TOP, depth - 1))
    key, first = m.byte_stream(Words(pa.array(new + learn)), depth)
    got = np.add.reduceat(m.log10_of(key, levels, depth), first[:-1])
    assert got == pytest.approx([plain.log10(stream(t)) for t in new + learn], rel=1e-9)


def test_probabilities_sum_to_one(documents):
    texts = pa.array([r.text for r in documents.limit(50).collect()])
    levels = whole_tree([m.byte_stream(Words(texts), 3)[0]], 3, 2)
    for context in (b"\0\0\0", b"the", b"\xff q"):
        start = sum(c << 8 * i for i, c in enumerate(context)) << 8
        assert (10 ** m.log10_of(np.arange(256, dtype=np.uint64) + np.uint64(start), levels, 3)).sum() == pytest.approx(1)


def test_documents_that_share_an_id(spark):
    rows = [(2, "one two three"), (2, "four five six seven"), (2, "one two three"), (None, "one two three"), (3, "four")]
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as tf", "3 as lp"), hot=1, most=1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(t.split()) + 1) for i, t in rows)
    assert len({r.score for r in got if r.n_tokens == 4}) == 1


def test_beats_the_base_when_there_is_enough_to_learn(spark):
    rows = [r for r in m.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("held_out", "n_tokens", "base_score", "score").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(odd):
    want = plain_base([(r.doc_id, r.text) for r in odd.collect()])
    got = [r for r in m.score(odd, nodes=1 << 20).collect()]
    assert order([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]) == order(want)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_empty(empty):
    assert m.score(empty, nodes=1 << 16).count() == 0


@pytest.mark.parametrize(("most", "nodes"), [(30, 1 << 8), (1 << 20, 1 << 20)])
def test_scores_are_those_of_the_whole_tree(spark, most, nodes):
    texts = ["the cat sat on the mat", "The dog sat", "a cat, a dog and a mat " * 3, "", "zebra \u00fc mat on", "THE DOG and the Mat"]
    rows = [*((i, t) for i, t in enumerate(texts * 3)), (3, ""), (4, texts[4])]
    plain = PlainTree([stream(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], m.DEPTH)
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string"), most=most, nodes=nodes).collect()
    assert any(r.held_out for r in got) and len(got) == len(rows)
    assert [r.score for r in sorted(got, key=lambda r: r.doc_id)] == pytest.approx([plain.log10(stream(t)) for _, t in sorted(rows)], rel=1e-9)
