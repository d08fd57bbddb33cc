"""Top-k retrieval by dot product or cosine, ties by id: exact, approximate, by words, and fused.

One query stays in SQL expressions and ends in a distributed top-k.  Many
queries are broadcast, as many at a time as fit a fixed number of bytes, and
one pass over the vectors serves them all: a task scores tiles of rows and
queries as matrix products and keeps the best k of each query, so what is
shuffled to the final ranking is queries x k rows a task, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.vectors import EPSILON, cosine, dot
from braidwork.session import written

#: Bytes of queries, and results held by a task, of one pass over the vectors.
QUERY_BYTES, RESULTS = 32 << 20, 1 << 21
#: Rows and queries whose scores are in memory at once.
TILE_ROWS, TILE_QUERIES = 2048, 512
#: Words of queries up to which documents are held against the words themselves rather than joined with them.
LITERAL_TERMS = 10_000


def _usable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def top_k(corpus: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "dot") -> DataFrame:
    """The k rows of corpus with the best score against one constant vector, with score and rk.

    k of 0 or less gives none.  Vectors that are null or hold null or NaN are
    left out, and so are NaN scores.
    """
    measure = {"dot": dot, "cosine": cosine}[metric]
    scored = _usable(corpus, vector).where(F.size(vector) == F.size(query)).withColumn("score", measure(F.col(vector), query)).where(~F.isnan("score"))
    best = scored.orderBy(F.desc("score"), F.asc(key)).limit(max(k, 0))
    return best.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))).cast("long"))  # k rows at most


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Best:
    """The k best (score, id) of each query so far; ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.room = 0, 2 * queries * k + TILE_ROWS * TILE_QUERIES

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.size += len(query)
        if self.size > self.room:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        self.held = [(query[keep], ids[keep], score[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _partial(shared, k: int, metric: str):
    """(qid, id, score): a task's k best rows (id, vector, list) of each query; with lists, only rows of the lists that a query probes count."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, probed = shared.value
        best = Best(len(qids), k)
        for b in batches:
            for at in range(0, b.num_rows, TILE_ROWS):
                part = b.slice(at, TILE_ROWS)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))
                if metric == "cosine":
                    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)
                lists = part.column(2).to_numpy() if probed is not None else None
                for of in [None] if lists is None else np.unique(lists).tolist():
                    rows = slice(None) if of is None else np.flatnonzero(lists == of)
                    some = np.arange(len(qids)) if of is None else probed.get(of, np.empty(0, int))
                    for lo in range(0, len(some), TILE_QUERIES):
                        mine = some[lo:lo + TILE_QUERIES]
                        scores = x[rows] @ q[mine].T
                        i, j = np.nonzero(scores >= best.least[mine])  # NaN is never at least anything
                        best.add(mine[j], ids[rows][i], scores[i, j])
        query, ids, score = best.prune()
        for at in range(0, len(query), 100_000):
            yield pa.record_batch([pa.array(x[at:at + 100_000]) for x in (np.asarray(qids)[query], ids, score)], names=["qid", "id", "score"])
    return op


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k).select("qid", F.col("id").alias(key), "score", "rk")


def _blocks(queries: DataFrame, size: int, k: int, query_bytes: int) -> Iterator[pa.Table]:
    """The queries (qid, v) of one vector size, in tables that one pass over the vectors serves."""
    per_pass = max(1, min(query_bytes // (8 * max(1, size)), RESULTS // k))
    blocks = -(-queries.count() // per_pass)
    for n in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n).toArrow().combine_chunks()
        if rows.num_rows:
            yield rows


def top_k_many(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "dot", query_bytes: int = QUERY_BYTES, centroids: np.ndarray | None = None, probes: int = 1) -> DataFrame:
    """(qid, <key>, score, rk) for every query (qid, vector): its k best rows of corpus, payload to be joined by key.

    With centroids, corpus has the column `list` (see assign_lists) and a query
    only sees the rows of the `probes` lists nearest to it.  k of 0 or less
    gives none; null vectors and those that hold null or NaN are left out, and
    a query only meets vectors of its size.  Queries are gathered when this is
    called, query_bytes of them for each pass over the corpus.
    """
    schema = f"qid long, {key} long, score double, rk long"
    spark = corpus.sparkSession
    if k <= 0:
        return spark.createDataFrame([], schema)
    ready = _usable(queries.select(F.col("qid").cast("long").alias("qid"), F.col(vector).alias("v")), "v")
    made = None
    for (size,) in ready.select(F.size("v")).distinct().collect():
        of = F.col("list") if centroids is not None else F.lit(0).alias("list")
        base = _usable(corpus, vector).where(F.size(vector) == size).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), of)
        for rows in _blocks(ready.where(F.size("v") == size), size, k, query_bytes):
            q, probed, held = _matrix(rows["v"].combine_chunks()), None, base
            if centroids is not None:
                near = nearest_lists(q, centroids, probes)
                probed = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
                held = base.where(F.col("list").isin(list(probed)))
            if metric == "cosine":
                q = q / (np.linalg.norm(q, axis=1, keepdims=True) + EPSILON)
            part = held.mapInArrow(_partial(spark.sparkContext.broadcast((rows["qid"].to_pylist(), q, probed)), k, metric), "qid long, id long, score double")
            made = part if made is None else made.unionByName(part)
    return spark.createDataFrame([], schema) if made is None else _ranked(made, k, key)


# ---- approximate search: an inverted file over k-means lists


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each row."""
    far = (centroids * centroids).sum(1) - 2 * x @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def learn_lists(corpus: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 15) -> np.ndarray:
    """Centroids by k-means on a sample: the `sample` rows with the least hash of their key; every row is indexed by them."""
    usable = _usable(corpus, vector)
    n = max(1, usable.count())
    h = F.xxhash64(key)
    some = usable.where(F.shiftrightunsigned(h, 1) <= min(2**63 - 1, 2**63 * 2 * sample // n)) if n > 2 * sample else usable
    x = _matrix(some.orderBy(h, key).limit(sample).select(vector).toArrow()[vector].combine_chunks())
    if not len(x):
        raise ValueError("there is nothing to learn lists from")
    centroids = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        own = nearest_lists(x, centroids, 1)[:, 0]
        total, many = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(total, own, x)
        centroids = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centroids)
    return centroids


def assign_lists(corpus: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """corpus with `list`, the number of the nearest centroid; write it partitioned by list and a search reads the lists it probes."""
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)
    usable = _usable(corpus, vector).where(F.size(vector) == centroids.shape[1])
    at = usable.columns.index(vector)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = nearest_lists(_matrix(b.column(at)), shared.value, 1)[:, 0]
                yield pa.record_batch([*b.columns, pa.array(own.astype(np.int32))], names=[*b.schema.names, "list"])

    return usable.mapInArrow(op, ", ".join(f"`{n}` {t}" for n, t in [*usable.dtypes, ("list", "int")]))


# ---- measures and fusion


def recall_at_k(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """(queries, recall): the share of (qid, key) pairs in truth that found has."""
    hit = truth.select("qid", key).distinct().join(found.select("qid", key).distinct().withColumn("hit", F.lit(1)), ["qid", key], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def best_of_many(found: DataFrame, owner: DataFrame, key: str = "vec_id") -> DataFrame:
    """(qid, owner, score): scores of several vectors of one owner, the best counting."""
    return found.join(owner, key).groupBy("qid", "owner").agg(F.max("score").alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, key: str = "id", constant: int = 60) -> DataFrame:
    """(qid, <key>, score, rk): rankings (qid, key, rk) merged by the sum of 1 / (constant + rk)."""
    every = rankings[0].select("qid", key, "rk")
    for r in rankings[1:]:
        every = every.unionByName(r.select("qid", key, "rk"))
    fused = every.groupBy("qid", key).agg(F.sum(1.0 / (constant + F.col("rk"))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(key))
    return fused.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, key: str = "id", constant: int = 60) -> DataFrame:
    """(qid, <key>, score, rk): a ranking by vectors and one by words, fused by reciprocal rank."""
    return reciprocal_rank_fusion([dense, sparse], k, key, constant)


def rerank(found: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, first: int = 20, key: str = "vec_id") -> DataFrame:
    """(qid, <key>, score, rk): the `first` best of a ranking scored anew, the k best of them.

    score takes (qid, <key>, ...) and gives it a column `score`, from an
    expression or a provider.
    """
    again = score(found.where(F.col("rk") <= first).drop("score"))
    return _ranked(again.select("qid", F.col(key).alias("id"), F.col("score").cast("double").alias("score")).where("score is not null"), k, key)


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """(qid, <key>, score, rk): Okapi BM25 over lower-cased words of letters and digits.

    Documents are split once, into their length and those words that a query
    has; only these are exploded and shuffled.  A word's weight is summed as a
    decimal of 18 places, so that the order of rows adds no rounding and equal
    texts tie.  The split documents are written when this is called.
    """
    terms = written(queries.select("qid", F.explode(F.array_distinct(words("text"))).alias("term")))
    distinct = terms.select("term").distinct()
    asked = [r[0] for r in distinct.limit(LITERAL_TERMS + 1).collect()]
    split = docs.where("text is not null").select(key, words("text").alias("w"))
    few = len(asked) <= LITERAL_TERMS
    cut = written(split.select(key, F.size("w").alias("len"), (F.filter("w", lambda w: w.isin(asked)) if few else F.col("w")).alias("w")))
    n, mean = cut.agg(F.count("*"), F.avg("len")).first()
    hits = cut.select(key, "len", F.explode("w").alias("term"))
    tf = (hits if few else hits.join(distinct, "term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
    scored = tf.join(df, "term").join(terms, "term").groupBy("qid", key).agg(F.sum(weight.cast("decimal(28,18)")).cast("double").alias("score"))
    return _ranked(scored.withColumnRenamed(key, "id"), k, key)
