import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions.vectors import as_floats, cosine, dot, norm
from braidwork.operators import retrieval as m

KIND = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_one_and_many_agree_with_numpy(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    x[50] = x[10]  # a tie
    x[60] = 0
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    q = x[10].astype(float)
    scores = x.astype(float) @ q if metric == "dot" else x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + 1e-10) @ (q / (np.linalg.norm(q) + 1e-10))
    want = sorted(range(200), key=lambda i: (-round(scores[i], 9), i))[:7]
    one = m.top_k(df, F.lit(x[10].tolist()).cast("array<float>"), 7, metric=metric)
    assert [r.vec_id for r in one.orderBy("rk").collect()] == want
    for block in (2 * 8 * 8, 1 << 20):
        many = m.top_k_many(df, df.where("vec_id in (10, 3, 4)").select(F.col("vec_id").alias("qid"), "embedding"), 7, metric=metric, query_bytes=block)
        assert [r.vec_id for r in many.where("qid = 10").orderBy("rk").collect()] == want
        assert many.count() == 21


def test_limits(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0, 0.0])])
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r.vec_id for r in m.top_k(df, q, 10).orderBy("rk").collect()] == [1, 2]
    assert m.top_k(df, q, 0).count() == 0 and m.top_k(df, q, -1).count() == 0
    asked = df.select(F.col("vec_id").alias("qid"), "embedding")
    assert m.top_k_many(df, asked, 0).count() == 0
    assert m.top_k_many(df, asked.limit(0), 3).count() == 0
    assert m.top_k_many(df.limit(0), asked, 3).count() == 0
    assert {(r.qid, r.vec_id) for r in m.top_k_many(df, asked, 9).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (6, 6)}


def test_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b")), dot(F.col("a"), F.col("b")), norm(F.col("b")), F.size(as_floats(F.col("a")))).first()[:] == (0.0, 0.0, 5**0.5, 2)


def test_single_query_plan_takes_ordered(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = m.top_k(df, F.lit([1.0] * 64), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(("rows", "queries", "k"), [(50, 7, 3), (3000, 600, 5), (5000, 3, 900)])
def test_many_tiles_agree_with_a_plain_sort(monkeypatch, rows, queries, k):
    rng = np.random.default_rng(k)
    x, q = rng.integers(-2, 3, (rows, 4)).astype(float), rng.integers(-2, 3, (queries, 4)).astype(float)  # many ties
    best = m.Best(queries, k)
    best.room = 2 * queries * k
    for lo in range(0, rows, 400):
        s = x[lo:lo + 400] @ q.T
        i, j = np.nonzero(s >= best.least)
        best.add(j, np.arange(rows)[lo:lo + 400][i], s[i, j])
    got_q, ids, _ = best.prune()
    for n in range(0, queries, max(1, queries // 7)):
        s = x @ q[n]
        assert ids[got_q == n].tolist() == sorted(range(rows), key=lambda i: (-s[i], i))[:k]


def test_inverted_file(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 16)) * 3
    x = (centers[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    centroids = m.learn_lists(df, 24, sample=1000)
    index = m.assign_lists(df, centroids)
    asked = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    truth = m.top_k_many(df, asked, 5, metric="cosine")
    few = m.recall_at_k(m.top_k_many(index, asked, 5, metric="cosine", centroids=centroids, probes=6), truth).first()
    assert few.queries == 30 and few.recall >= 0.9
    every = m.top_k_many(index, asked, 5, metric="cosine", centroids=centroids, probes=24)
    assert sorted(map(tuple, every.select("qid", "vec_id", "rk").collect())) == sorted(map(tuple, truth.select("qid", "vec_id", "rk").collect()))
    assert index.count() == 3000
    with pytest.raises(ValueError):
        m.learn_lists(df.limit(0), 4)


def test_words_beyond_literals_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "A cat, a dog"), (2, "dog dog"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "dog"), (2, "cat mouse")], "qid long, text string")
    want = [tuple(r) for r in m.bm25(docs, asked, 5).orderBy("qid", "rk").collect()]
    monkeypatch.setattr(m, "LITERAL_TERMS", 1)
    assert [tuple(r) for r in m.bm25(docs, asked, 5).orderBy("qid", "rk").collect()] == want
    assert [(r[0], r[1]) for r in want] == [(1, 2), (1, 1), (2, 1)]


def test_equal_texts_tie_whatever_the_order_of_their_rows(spark):
    """Sums of doubles in the order of the shuffle would rank copies by their rounding."""
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i} " * (1 + i % 7) for i in range(60))
    other = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(3, 30))) for _ in range(300)]
    docs = spark.createDataFrame([(i, text if i % 2 else other[i]) for i in range(300)], "doc_id long, text string").repartition(8)
    asked = spark.createDataFrame([(1, text)], "qid long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a text's rows come from several partitions, as they do at size
    try:
        got = [r.doc_id for r in m.bm25(docs, asked, 150).orderBy("rk").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == list(range(1, 300, 2))


def test_reranking_takes_the_first(spark):
    found = spark.createDataFrame([(1, i, float(-i), i + 1) for i in range(9)], "qid long, vec_id long, score double, rk long")
    got = m.rerank(found, lambda df: df.withColumn("score", F.col("vec_id") * 1.0), 2, first=4)
    assert [(r.vec_id, r.rk) for r in got.orderBy("rk").collect()] == [(3, 1), (2, 2)]
