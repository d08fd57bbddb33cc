"""Quality scores from compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained, on texts labelled good and on texts
labelled bad.  A text is compressed with either, BLOCK bytes at a time, so
that a long text is held against the dictionaries to its end rather than
against its own beginning.  Text compresses better under the dictionary of
its own kind: the difference of the two compressed sizes, per byte of text, is
the evidence, and a logistic curve over it, fitted on labelled texts that the
dictionaries have not seen, turns it into a probability.

Fitting uses a bounded sample, SAMPLE labelled texts of either kind for the
dictionaries and as many for the curve, the ones with the least hash of their
id.  The dictionaries, of a fixed size, learn from SAMPLE_BYTES of a longer
text, in blocks spread from its start to its end.  The curve's differences are
computed from whole texts in the executors, so that it is fitted on what it is
applied to; only they reach the driver.  Scoring reads every text whole, in one
narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.words import slices

SAMPLE, SAMPLE_BYTES, BLOCKS, DICTIONARY_BYTES, BLOCK, LEVEL = 1500, 8192, 8, 64 << 10, 1024, 3
THRESHOLD = 0.3


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = map(self._one, (good, bad))

    @staticmethod
    def _one(data: bytes) -> zstandard.ZstdCompressor:
        dictionary = None
        if data:
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: bytes) -> float:
        """How many bytes fewer the good dictionary takes than the bad one, for each byte of text."""
        more = 0
        for at in range(0, len(text), BLOCK):
            block = text[at:at + BLOCK]
            more += len(self.bad.compress(block)) - len(self.good.compress(block))
        return more / (len(text) + 16.0)


class Model:
    """Dictionaries and the curve; without labels of both kinds the share of good ones is the score."""

    def __init__(self, good: bytes, bad: bytes, intercept: float, slope: float):
        self.good, self.bad, self.intercept, self.slope = good, bad, intercept, slope

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -30, 30)))


def train_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; the texts themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Penalised maximum likelihood by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spread(text: F.Column) -> F.Column:
    """The bytes of a text, of more than SAMPLE_BYTES as many in BLOCKS blocks from its start to its end."""
    size = SAMPLE_BYTES // BLOCKS
    at = [(F.floor((F.length(text) - size) * k / (BLOCKS - 1)) + 1).cast("int") for k in range(BLOCKS)]
    return F.when(F.length(text) <= SAMPLE_BYTES, text).otherwise(F.concat(*(F.substring(text, a, F.lit(size)) for a in at)))


def _differences(shared):
    """(label, x) from (label, text)."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(*shared.value)
        for b in slices(batches):
            x = [c.difference(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.float64())], names=["label", "x"])
    return op


def fit(docs: DataFrame, known: DataFrame) -> Model:
    """Learn from docs (doc_id, text) with known labels (doc_id, label): a bounded sample of either label.

    The sample is drawn from the labels, so its size is known before any text
    is read and it can be broadcast: texts are not shuffled.  The curve's
    intercept is moved to the labels' true proportion afterwards.
    """
    counts = dict(known.groupBy("label").count().collect())
    h = F.xxhash64("doc_id")
    picked = None
    for k, n in counts.items():
        # a cut by hash leaves a few samples' worth of rows, whatever the input, of which the least are taken
        some = known.where(F.col("label") == k).where(F.shiftrightunsigned(h, 1) <= min(2**63 - 1, 2**63 * 4 * SAMPLE // n)).orderBy(h, "doc_id").limit(2 * SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    prior = np.log(share / (1 - share))
    flat = Model(b"", b"", float(prior), 0.0)
    if picked is None:
        return flat
    # every other one is for the curve
    picked = cut(picked.withColumn("curve", F.row_number().over(Window.partitionBy("label").orderBy(h, "doc_id")) % 2 == 0))
    texts = small_batches(docs).where("text <> ''").join(F.broadcast(picked), "doc_id").select("label", "curve", F.xxhash64("text").alias("h"), "text")
    rows = texts.where("not curve").select("label", "h", spread(F.encode("text", "UTF-8")).alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["label"], r["text"]))
    kinds = [[r["text"] for r in rows if r["label"] == k] for k in (0, 1)]
    if not all(kinds):
        return flat
    bad, good = map(train_dictionary, kinds)
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))
    seen = texts.where("curve").select("label", "text").mapInArrow(_differences(shared), "label int, x double").toArrow().to_pylist()
    seen.sort(key=lambda r: (r["label"], r["x"]))
    y = np.array([float(r["label"]) for r in seen])
    if not 0 < y.sum() < len(y):
        return flat
    x = np.array([r["x"] for r in seen])
    mean, scale = x.mean(), x.std() + 1e-9
    w = logistic(np.stack([np.ones(len(x)), (x - mean) / scale], axis=1), y)
    w[0] += prior - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, float(w[0] - w[1] * mean / scale), float(w[1] / scale))


def _score(shared, threshold: float):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        c = Compressors(model.good, model.bad)
        for b in slices(batches):
            text = b.column(1).cast(pa.binary()).to_pylist()
            score = model.score(np.array([c.difference(t or b"") for t in text]))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return op


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    labels has doc_id and quality; rows that are held out, without doc_id or
    with another label than 0 and 1 are not learned from.  Null texts score as
    empty ones.  Without labels of both kinds every score is the share of good
    labels, 0.5 without any.  Other columns are not read.  The model is fitted
    when this is called.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out())
    model = fit(docs.select("doc_id", "text"), known)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(shared, threshold), "doc_id long, held_out boolean, score double, predicted int")
