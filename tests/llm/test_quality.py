import math
import random
import struct
import zlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from braidwork.llm import quality as m


def auc(pairs):
    good = [s for s, y in pairs if y == 1]
    bad = [s for s, y in pairs if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = m.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.97
    assert abs(sum(s for s, _ in held) / len(held) - sum(y for _, y in held) / len(held)) < 0.05  # calibrated


def test_held_out_labels_are_not_used(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(m.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    plain = {r.doc_id: r.score for r in m.classify(documents, labels).collect()}
    assert {r.doc_id: r.score for r in m.classify(documents, flipped).collect()} == plain


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, None, 0), (8, 3, 0), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = m.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in m.classify(odd, none).collect()} == {0.5}
    assert m.classify(empty, labels).count() == 0


def test_evidence_after_the_first_8_kb_counts(spark):
    rng = random.Random(8)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)] for _ in range(3)]
    text = lambda label: " ".join(rng.choices(words[2], k=1200) + rng.choices(words[label], k=1500))
    rows = [(i, text(i % 2), i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = [(r.score, r.doc_id % 2) for r in m.classify(docs, labels).collect() if r.held_out]
    assert len(held) > 30 and auc(held) > 0.95
    assert abs(sum(s for s, _ in held) / len(held) - sum(y for _, y in held) / len(held)) < 0.1


def key(i):
    """Spark's xxhash64 of a long."""
    return np.uint64(xxhash.xxh64_intdigest(struct.pack("<q", i), 42)).astype(np.int64)


def plain_scores(docs, labels):
    """The classifier in plain loops: (doc_id, text) and (doc_id, label)."""
    text = {i: (t or "").encode() for i, t in docs}
    known = sorted((int(key(i)), i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 != 0 and y in (0, 1))
    for_curve, for_dictionary = [], ([], [])
    for kind in (0, 1):
        own = [i for _, i, y in known if y == kind]
        for_curve += [(i, kind) for i in own[1::2] if text.get(i)]
        for_dictionary[kind].extend(i for i in own[::2] if text.get(i))

    def spread(t):
        return t if len(t) <= 8192 else b"".join(t[(len(t) - 1024) * k // 7:][:1024] for k in range(8))

    made = []
    for own in for_dictionary:
        samples = sorted((int(np.uint64(xxhash.xxh64_intdigest(text[i], 42)).astype(np.int64)), spread(text[i])) for i in own)
        made.append(m.train_dictionary([t for _, t in samples]))
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in made]

    def difference(t):
        bad, good = (sum(len(p.compress(t[a:a + 1024])) for a in range(0, len(t), 1024)) for p in packers)
        return (bad - good) / (len(t) + 16)

    x, y = np.array([difference(text[i]) for i, _ in for_curve]), np.array([float(k) for _, k in for_curve])
    mean, scale = x.mean(), x.std() + 1e-9
    a, b = 0.0, 0.0
    for _ in range(200):  # Newton steps on the penalised likelihood
        z = (x - mean) / scale
        p = 1 / (1 + np.exp(-(a + b * z)))
        g = np.array([(y - p).sum() - 1e-6 * a, ((y - p) * z).sum() - b])
        q = p * (1 - p) + 1e-9
        h = np.array([[q.sum() + 1e-6, (q * z).sum()], [(q * z).sum(), (q * z * z).sum() + 1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    share = (sum(k for *_, k in known) + 1) / (len(known) + 2)
    a += math.log(share / (1 - share)) - math.log(y.sum() / (len(y) - y.sum()))
    return {i: 1 / (1 + math.exp(-(a + b * (difference(t) - mean) / scale))) for i, t in text.items()}


def test_scores_match_plain_loops(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = plain_scores([(r.doc_id, r.text) for r in documents.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r.score for r in m.classify(documents, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_clashing_columns(odd, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 0), (9, 1)], "doc_id long, quality int").selectExpr("*", "'x' as text", "7 as label", "8 as h", "9 as curve")
    docs = odd.selectExpr("*", "1 as label", "2 as held_out", "3 as score", "4 as quality", "5 as predicted")
    assert m.classify(docs, labels).count() == odd.count()
