"""Language identification as multilingual mixture inference.

Model: byte-trigram probabilities of each labelled language over the letters
of a text (A-Z lower-cased, other bytes are gaps), hashed to a fixed number of
buckets, counted over all learning documents by one pre-aggregated shuffle.
Its size is languages x BUCKETS, whatever the corpus, which is what the driver
gathers and broadcasts.

Inference: a word's likelihood under a language is the product of its
trigrams'.  Expectation-maximisation over a document's words estimates the
proportion of each language.  The language set is then chosen by penalised
likelihood: starting from the best single language, the most present next
language joins while the log-likelihood gains more than PENALTY x ln(words).
Documents are scored in one narrow pass, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import small_batches
from braidwork.llm.words import Words, slices

BUCKETS, ROUNDS, PENALTY, SMOOTH = 1 << 15, 10, 2.0, 0.1
UNKNOWN = "und"
#: ASCII letters lower-cased and all bytes of multi-byte characters; the rest is a gap.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
IS_LETTER = LETTERS != 32


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(bucket of each letter's trigram, first letter of each word in that list, words)."""
    w = Words(text, IS_LETTER)
    c = LETTERS[w.data].astype(np.uint32)
    before, after = np.empty_like(c), np.empty_like(c)
    if len(c):
        before[0], before[1:] = 32, c[:-1]
        after[-1], after[:-1] = 32, c[1:]
    before[w.start] = 32
    after[w.end - 1] = 32
    size = w.end - w.start
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(w.start - begin, size)
    gram = before[at] << np.uint32(16) | c[at] << np.uint32(8) | after[at]
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket, begin, w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def flush():
        for lang, c in total.items():
            some = np.flatnonzero(c)
            if len(some):
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "bucket", "c"])
        total.clear()

    for b in slices(batches):
        bucket, _, w = trigrams(b.column(0))
        langs = np.array(b.column(1).to_pylist(), dtype=object)
        letters = np.add.reduceat(np.append(w.end - w.start, 0), np.minimum(w.first[:-1], len(w))) if len(w) else np.zeros(len(langs), int)
        letters[np.diff(w.first) == 0] = 0
        label = np.repeat(np.arange(len(langs)), letters)
        for lang in set(langs.tolist()):
            rows = langs == lang
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += np.bincount(bucket[rows[label]], minlength=BUCKETS)
        if len(total) > 256:
            yield from flush()
    yield from flush()


class Model:
    """languages (sorted) and the log-probability of every bucket under each."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p


def fit(labelled: DataFrame) -> Model:
    """Learn from all rows of labelled (text, lang); null texts and languages are skipped."""
    counted = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, bucket int, c long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    c = np.zeros((BUCKETS, len(languages)))
    if languages:
        place = {x: i for i, x in enumerate(languages)}
        c[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["c"].to_numpy()
    return Model(languages, np.log((c + SMOOTH) / (c.sum(0) + SMOOTH * BUCKETS)).astype(np.float32))


def _em(like: np.ndarray, scale: np.ndarray, row: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each row; like: words x languages, each word's best is 1 and scale its log."""
    share = allowed / allowed.sum(1, keepdims=True)
    n = np.diff(np.append(first, len(row)))[:, None]
    for _ in range(rounds):
        part = like * share[row]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / n
    total = np.log((like * share[row]).sum(1)) + scale
    return share, np.add.reduceat(total, first)


def infer(log_p: np.ndarray, text: pa.Array) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """(rows that have words, their languages by falling share, shares in the chosen set, shares over all)."""
    bucket, begin, w = trigrams(text)
    count = np.diff(w.first)
    rows = np.flatnonzero(count)
    if not len(rows) or not log_p.shape[1]:
        none = np.empty((0, log_p.shape[1]))
        return np.empty(0, int), [], none, none
    each = np.add.reduceat(log_p[bucket], begin, axis=0).astype(np.float64)
    scale = each.max(1)
    like = np.maximum(np.exp(each - scale[:, None]), 1e-30)
    row = np.repeat(np.arange(len(rows)), count[rows])
    first = np.cumsum(count[rows]) - count[rows]
    languages = log_p.shape[1]
    every, _ = _em(like, scale, row, first, np.ones((len(rows), languages)))
    single = np.add.reduceat(np.log(like), first, axis=0) + np.add.reduceat(scale, first)[:, None]
    chosen = np.zeros_like(every)
    best = single.argmax(1)
    chosen[np.arange(len(rows)), best] = 1
    reached = single.max(1)
    allowed = chosen.copy()
    rank = np.argsort(-every, axis=1, kind="stable")
    active = np.arange(len(rows))
    for _ in range(languages - 1):
        # the most present language not yet in the set
        order = rank[active]
        out = np.take_along_axis(allowed[active], order, 1) == 0
        joins = order[np.arange(len(active)), out.argmax(1)]
        trial = allowed[active].copy()
        trial[np.arange(len(active)), joins] = 1
        likely = every[active, joins] * count[rows[active]] >= 1  # at least a word's worth of it
        active, trial = active[likely], trial[likely]
        if not len(active):
            break
        pick = np.zeros(len(rows), bool)
        pick[active] = True
        words = pick[row]
        sub = np.repeat(np.arange(len(active)), count[rows[active]])
        start = np.cumsum(count[rows[active]]) - count[rows[active]]
        share, total = _em(like[words], scale[words], sub, start, trial)
        better = total - reached[active] > PENALTY * np.log(np.maximum(count[rows[active]], 2))
        active = active[better]
        if not len(active):
            break
        chosen[active], allowed[active], reached[active] = share[better], trial[better], total[better]
    sets = [[int(k) for k in np.argsort(-chosen[i], kind="stable") if allowed[i, k]] for i in range(len(rows))]
    return rows, sets, chosen, every


def _answers(model: Model, text: pa.Array) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]]]:
    """(language, score, chosen languages, their shares) of each text."""
    n = len(text)
    pred, score = [UNKNOWN] * n, np.zeros(n)
    sets: list[list[str]] = [[] for _ in range(n)]
    shares: list[list[float]] = [[] for _ in range(n)]
    rows, chosen, share, every = infer(model.log_p, text)
    for i, (r, langs) in enumerate(zip(rows.tolist(), chosen, strict=True)):
        own = text[r].as_py()
        if not any(map(str.isalpha, own[:200])) and not any(map(str.isalpha, own)):
            continue  # multi-byte characters that are no letters
        pred[r] = model.languages[langs[0]]
        score[r] = min(1.0, max(0.0, float(every[i, langs[0]])))
        sets[r] = [model.languages[k] for k in langs]
        shares[r] = [float(share[i, k]) for k in langs]
    return pred, score, sets, shares


def _limit(model: Model) -> int:
    return max(1 << 16, (1 << 23) // max(4, len(model.languages)))


def _predict(shared):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_limit(shared.value)):
            pred, score, sets, shares = _answers(shared.value, b.column(1))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                                  names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])
    return op


def _relabel(shared):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_limit(shared.value)):
            pred = pa.array(_answers(shared.value, b.column(1))[0], pa.string())
            at = b.schema.get_field_index("lang")
            out = pa.record_batch([pred if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
            yield out.filter(pa.compute.not_equal(pred, UNKNOWN))
    return op


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions for every row.

    Learns from rows that are not held out and have a language; lang_pred is the
    language with the largest share of the chosen set and score its share over
    all languages.  Null texts and texts without a letter are `und` with score
    0, and so is everything if nothing could be learned.  Rows without doc_id
    are neither held out nor learned from.
    """
    rows = small_batches(docs).select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInArrow(
        _predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")


def relabel_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, n_chars) with the predicted language as lang, without those that are `und`.

    Null and empty texts and texts without a letter are `und`; rows without
    doc_id stay if their text has a language.  Other columns go.
    """
    model = fit(small_batches(docs).select("text", "lang", held_out().alias("held_out")).where(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(_relabel(shared), "doc_id long, text string, lang string, source string, n_chars long")
