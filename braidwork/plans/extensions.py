"""Queries beyond the core: what only the written notes describe."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import payload
from braidwork.functions.vectors import cosine
from braidwork.operators import agent, retrieval, state
from braidwork.plans.core import ASKED, COSINE, LATEST_SQL, SCALED_SQL, _args, _events, _log, _many_sql, _queries, _scaled, _shown, _top, ARGS_SQL, query
from braidwork.session import table


@query(f"SELECT qid, vec_id, round(score, 4) AS score, rk FROM ({_many_sql(5, ASKED, where='e.label = 3')})")
def ext_filtered_topk(spark, d):
    e = table(spark, d, "embeddings")
    return _shown(retrieval.top_k_many(e.where("label = 3"), _queries(e, ASKED), 5))


FUSED_SQL = f"""SELECT qid, vec_id, round(score, 6) AS score, rk FROM (SELECT qid, vec_id, sum(1.0 / (60 + rk)) AS score, row_number() OVER (PARTITION BY qid ORDER BY sum(1.0 / (60 + rk)) DESC, vec_id) AS rk
FROM (SELECT qid, vec_id, rk FROM ({_many_sql(10, ASKED, where="e.label < 5")}) UNION ALL SELECT qid, vec_id, rk FROM ({_many_sql(10, ASKED, score=COSINE, rel=SCALED_SQL)})) GROUP BY qid, vec_id) WHERE rk <= 5"""


@query(FUSED_SQL)
def ext_rank_fusion(spark, d):
    e = table(spark, d, "embeddings")
    one = retrieval.top_k_many(e.where("label < 5"), _queries(e, ASKED), 10)
    fused = retrieval.reciprocal_rank_fusion([one, _top(_scaled(e), ASKED, 10, "cosine")], 5, "vec_id")
    return fused.select("qid", "vec_id", F.round("score", 6).alias("score"), "rk")


def _bm25_sql(asked: str, k: int) -> str:
    """Okapi BM25 of documents for queries (qid, text)."""
    return f"""WITH toks AS (SELECT doc_id, [w for w in regexp_split_to_array(lower(text), '[^a-z0-9]+') if w <> ''] AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
terms AS (SELECT qid, unnest(list_distinct([w for w in regexp_split_to_array(lower(text), '[^a-z0-9]+') if w <> ''])) AS term FROM ({asked})),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY qid, doc_id)
SELECT qid, doc_id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM s) WHERE rk <= {k}"""


@query(f"SELECT qid, doc_id, round(score, 4) AS score, rk FROM ({_bm25_sql('SELECT item_id AS qid, text FROM benchmark WHERE item_id % 100 = 0', 3)})")
def ext_bm25(spark, d):
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25(table(spark, d, "documents"), asked, 3).select("qid", "doc_id", F.round("score", 4).alias("score"), "rk")


@query(f"""SELECT count(DISTINCT t.qid) AS queries, round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM ({_many_sql(5, ASKED)}) t
LEFT JOIN ({_many_sql(5, ASKED, where="e.label % 2 = 0")}) f ON t.qid = f.qid AND t.vec_id = f.vec_id""")
def ext_recall(spark, d):
    e = table(spark, d, "embeddings")
    half = retrieval.top_k_many(e.where("label % 2 = 0"), _queries(e, ASKED), 5)
    return retrieval.recall_at_k(half, _top(e, ASKED, 5)).select("queries", F.round("recall", 6).alias("recall"))


@query(f"SELECT qid, label AS owner, round(max(score), 4) AS score FROM ({_many_sql(10, ASKED)}) JOIN embeddings USING (vec_id) GROUP BY qid, label")
def ext_best_of_many(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.best_of_many(_top(e, ASKED, 10), e.select("vec_id", F.col("label").alias("owner"))).select("qid", "owner", F.round("score", 4).alias("score"))


@query("""SELECT user_id || '/' || event_type AS idempotency_key, arg_min(event_id, (ts, event_id)) AS seq, count(*) AS attempts FROM events GROUP BY 1""")
def ext_ledger(spark, d):
    calls = _log(spark, d, idempotency_key=F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")))
    return agent.ledger(calls).select("idempotency_key", "seq", "attempts")


@query(f"""SELECT event_id, CASE WHEN NOT json_valid(a) THEN 'not JSON' WHEN json_extract_string(a, '$.room') IS NULL THEN 'missing room' ELSE '' END AS errors FROM (SELECT event_id, {ARGS_SQL} AS a FROM events)""")
def ext_args_validation(spark, d):
    schema = {"type": "object", "properties": {"room": {"type": "string"}, "k": {"type": "number"}}, "required": ["room"]}
    return _events(spark, d).select("event_id", F.array_join(payload.schema_errors(_args(), schema), "; ").alias("errors"))


@query(f"""SELECT user_id, CASE WHEN t > 30 OR t < 15 THEN 'reject' WHEN t > 26 THEN 'confirm' WHEN user_id % 20 < 16 THEN 'alert' ELSE 'ok' END AS verdict, round(t * 2) / 2 AS setting
FROM (SELECT user_id, floor(value) % 40 AS t FROM ({LATEST_SQL}))""")
def ext_temperature_rules(spark, d):
    last = state.last_write(_log(spark, d, user_id=F.col("user_id"), value=F.col("value")), "user_id", "value")
    t = (F.floor("value") % 40).cast("double")
    return last.select("user_id", state.temperature_rule(t, F.col("user_id") % 20).alias("verdict"), state.half_degrees(t).alias("setting"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type AS name, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""")
def ext_calls_per_hour(spark, d):
    return _events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("window_start"), F.col("event_type").alias("name")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))


HYBRID_SQL = f"""SELECT qid, id, round(score, 6) AS score, rk FROM (SELECT qid, id, sum(1.0 / (60 + rk)) AS score, row_number() OVER (PARTITION BY qid ORDER BY sum(1.0 / (60 + rk)) DESC, id) AS rk
FROM (SELECT qid, vec_id AS id, rk FROM ({_many_sql(10, ASKED)}) UNION ALL SELECT qid, doc_id AS id, rk FROM ({_bm25_sql("SELECT vec_id AS qid, b.text FROM embeddings JOIN benchmark b ON item_id = vec_id // 100 WHERE " + ASKED, 10)})) GROUP BY qid, id) WHERE rk <= 5"""


@query(HYBRID_SQL)
def ext_hybrid(spark, d):
    """Items are known by vec_id = doc_id; a query has a vector and the text of a benchmark item."""
    e = table(spark, d, "embeddings")
    said = table(spark, d, "benchmark").select((F.col("item_id") * 100).alias("qid"), "text").join(_queries(e, ASKED).select("qid"), "qid")
    sparse = retrieval.bm25(table(spark, d, "documents"), said, 10)
    dense = _top(e, ASKED, 10).withColumnRenamed("vec_id", "id")
    return retrieval.hybrid(dense, sparse.withColumnRenamed("doc_id", "id"), 5).select("qid", "id", F.round("score", 6).alias("score"), "rk")


@query(f"""SELECT qid, vec_id, round(score, 4) AS score, rk FROM (SELECT c.qid, c.vec_id, s.score, row_number() OVER (PARTITION BY c.qid ORDER BY s.score DESC, c.vec_id) AS rk
FROM (SELECT qid, vec_id FROM ({_many_sql(20, ASKED)})) c JOIN (SELECT q.vec_id AS qid, e.vec_id, {COSINE} + CASE WHEN e.label = q.label THEN 0.5 ELSE 0 END AS score FROM {SCALED_SQL} e, {SCALED_SQL} q WHERE q.{ASKED}) s ON s.qid = c.qid AND s.vec_id = c.vec_id) WHERE rk <= 5""")
def ext_rerank(spark, d):
    """The twenty best by vector, scored anew with a bonus for the query's label, as a model would with the text."""
    e = _scaled(table(spark, d, "embeddings"))

    def score(found):
        sides = found.join(e.select("vec_id", "embedding", "label"), "vec_id").join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("asked")), "qid")
        return sides.withColumn("score", cosine(F.col("embedding"), F.col("q")) + F.when(F.col("label") == F.col("asked"), 0.5).otherwise(0.0))

    return _shown(retrieval.rerank(_top(table(spark, d, "embeddings"), ASKED, 20), score, 5))


@query(f"SELECT count(*) AS queries, true AS recall_of_nine_tenths FROM embeddings WHERE {ASKED}")
def ext_ann(spark, d):
    """Recall@5 of the inverted file against the exact search: 32 lists, of which a query probes 24 (the vectors have hardly any clusters)."""
    e = table(spark, d, "embeddings")
    centroids = retrieval.learn_lists(e, 32)
    found = retrieval.top_k_many(retrieval.assign_lists(e, centroids), _queries(e, ASKED), 5, centroids=centroids, probes=24)
    return retrieval.recall_at_k(found, _top(e, ASKED, 5)).select("queries", (F.col("recall") >= 0.9).alias("recall_of_nine_tenths"))


TURNS_SQL = "SELECT CASE user_id % 3 WHEN 0 THEN 'garage' WHEN 1 THEN 'front_door' ELSE 'back_door' END AS door, CASE WHEN event_type IN ('click', 'signup') THEN 'open' ELSE 'closed' END AS status, ts, event_id FROM events"
LEFT_OPEN_SQL = f"""SELECT door, ts AS opened_ts, CASE WHEN next_ts < ts + to_minutes(m) THEN next_ts ELSE ts + to_minutes(m) END AS closes_ts, CASE WHEN next_ts < ts + to_minutes(m) THEN 'command' ELSE 'timer' END AS closed_by
FROM (SELECT *, lead(ts) OVER (PARTITION BY door ORDER BY ts, event_id) AS next_ts, CASE WHEN door = 'garage' THEN 10 ELSE 5 END AS m FROM
 (SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY door ORDER BY ts, event_id) AS before FROM ({TURNS_SQL})) WHERE before IS NULL OR before <> status)) WHERE status = 'open'"""


def _door_log(spark, d):
    k = F.col("user_id") % 3
    return _events(spark, d).select(F.when(k == 0, "garage").when(k == 1, "front_door").otherwise("back_door").alias("door"), F.when(F.col("event_type").isin("click", "signup"), "open").otherwise("closed").alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@query(f"SELECT door, closed_by, count(*) AS n, CAST(sum(epoch_us(CAST(closes_ts AS TIMESTAMP)) - epoch_us(CAST(opened_ts AS TIMESTAMP))) AS BIGINT) AS open_us FROM ({LEFT_OPEN_SQL}) GROUP BY door, closed_by")
def ext_door_timers(spark, d):
    log = _door_log(spark, d)
    every = state.garage_closings(log).unionByName(state.lock_closings(log))
    return every.groupBy("door", "closed_by").agg(F.count("*").alias("n"), F.sum(F.unix_micros("closes_ts") - F.unix_micros("opened_ts")).alias("open_us"))


@query(f"""SELECT CAST(day AS VARCHAR) AS day FROM (SELECT CAST(ts AS DATE) AS day, arg_max(status, (ts, event_id)) AS status FROM ({TURNS_SQL}) WHERE door = 'garage' AND hour(ts) < 22 GROUP BY 1) WHERE status = 'open'""")
def ext_night_garage(spark, d):
    return state.night_garage(_door_log(spark, d)).select(F.col("day").cast("string").alias("day"))


@query(f"""SELECT event_id AS seq, coalesce(len(o), 0) > 0 AS alert, coalesce(array_to_string(o, ','), '') AS open_doors FROM events, (SELECT list(door ORDER BY door) AS o FROM (SELECT door, arg_max(status, (ts, event_id)) AS status FROM ({TURNS_SQL}) GROUP BY door) WHERE status = 'open') WHERE event_id % 100 = 0""")
def ext_leaving_check(spark, d):
    doors = state.last_write(_door_log(spark, d), "door", "status")
    leaving = _events(spark, d).where("event_id % 100 = 0").select(F.col("event_id").alias("seq"))
    return state.leaving_check(leaving, doors).select("seq", "alert", F.array_join("open_doors", ",").alias("open_doors"))
