"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Model.  A text is its words (A-Z lower-cased), each followed by a space, and
one more space as its end: an empty word.  A byte is eight binary decisions,
and each decision has a context tree over the DEPTH bytes before it, nearest
first.  Nodes hold zero and one counts with Krichevsky-Trofimov estimates, and
context-tree weighting mixes the estimates of all depths:
P_w = KT / 2 + (product of the children's P_w) / 2.  After learning, KT / 2
over P_w is a node's probability of being the last of its path, and a
decision's probability is the mixture along its path; a path ends at its last
node that was seen in learning.

How it scales.
1. Contexts with their next byte (grams) are counted over all texts, slice by
   slice, by one pre-aggregated shuffle into a distributed table, where none
   is cut, merged or left out.
2. The tree is never in one place.  Contexts that share their TOP + 1 nearest
   bytes are a shard: it holds all nodes below depth TOP of its grams, so a
   task weights shards without the others.  Only the nodes of depth TOP, sums
   over the shards, reach the driver (there are at most 256^TOP x 255 of them
   in any corpus); it weights the depths above and broadcasts these.  A second
   pass over the shards then scores every gram that occurs in any text.
3. Documents are scored in one pass.  The commonest grams' scores, GRAMS of
   them at most, are broadcast; a document meets those of its other grams in
   a join without hot keys.  So GRAMS decides where a score is looked up,
   never what it is.
4. The unigram base needs the count of every token.  The commonest words, HOT
   of them at most, are broadcast; the others are in the same join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.words import LOWER, U, Words, mix, slices, trim

DEPTH, TOP, GRAMS, HOT = 5, 2, 1 << 20, 1 << 18
CACHE, SLICE = 1 << 20, 1 << 20
#: Nodes of the distributed tree that a task weights together; a shard is not divided.
NODES = 1 << 20
#: Marks grams of texts that are not learned from, above the bytes of a gram.
UNLEARNED = 1 << 62


def byte_stream(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every coded byte, first byte of each row and the end): key holds the bytes before, nearest highest, and the byte."""
    size = w.end - w.start
    rows = len(w.first) - 1
    total = np.concatenate(([0], np.cumsum(size + 1)))
    coded = total[w.first[1:]] - total[w.first[:-1]] + 1
    begin = np.cumsum(coded + depth) - coded  # `depth` zeros stand before each row
    flat = np.zeros(int(begin[-1] + coded[-1]) if rows else 0, np.uint8)
    if len(size):
        word_at = np.repeat(begin - total[w.first[:-1]], np.diff(w.first)) + total[:-1]
        before = np.cumsum(size) - size
        run = np.arange(int(size.sum()))
        flat[run + np.repeat(word_at - before, size)] = LOWER[w.data[run + np.repeat(w.start - before, size)]]
        flat[word_at + size] = 32
    if rows:
        flat[begin + coded - 1] = 32
    key = np.zeros(len(flat), U)
    for d in range(1, depth + 1):
        key[d:] |= flat[:-d].astype(U) << U(8 * (depth - d) + 8)
    key |= flat
    first = np.concatenate(([0], np.cumsum(coded)))
    at = np.arange(int(first[-1])) + np.repeat(begin - first[:-1], coded)
    return key[at], first


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
    return key[new], np.add.reduceat(count, new) if len(new) else count


def _count_grams(depth: int, held: int = 1 << 21):
    """(key, c) of texts; with a second column, whether a text is learned from, the others' keys have UNLEARNED set."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def out():
            key, count = _merge(keys, counts)
            keys.clear()
            counts.clear()
            for k in range(0, len(key), 100_000):
                yield pa.record_batch([pa.array(key[k:k + 100_000].view(np.int64)), pa.array(count[k:k + 100_000])], names=["key", "c"])

        for b in slices(batches, limit=SLICE):
            key, first = byte_stream(Words(b.column(0)), depth)
            if b.num_columns > 1:
                learns = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                key = key | np.repeat(np.where(learns, U(0), U(UNLEARNED)), np.diff(first))
            key, count = np.unique(key, return_counts=True)
            keys.append(key)
            counts.append(count.astype(np.int64))
            size += len(key)
            if size > held:
                key, count = _merge(keys, counts)
                keys[:], counts[:], size = [key], [count], len(key)
                if size > held // 2:
                    yield from out()
                    size = 0
        if keys:
            yield from out()
        trim()
    return op


def _level(count: str) -> F.Column:
    return F.floor(F.log2(F.col(count)) * 64)  # a few thousand classes at most


def _at_least(df: DataFrame, count: str, most: int) -> int | None:
    """The least class of counts such that at most `most` rows are in it or above; None if its largest class has more."""
    total, least = 0, None
    for t, k in df.groupBy(_level(count).alias("t")).agg(F.count("*").alias("k")).orderBy(F.desc("t")).collect():
        total += k
        if total > most:
            break
        least = t
    return least


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        s = s - np.log(x + i)
    return s


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _decisions(context: np.ndarray, symbol: np.ndarray, count: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, n0, n1) of one decision, sorted by node = context and bits so far; input distinct and sorted."""
    at = context << U(8) | (U(1 << bit) | symbol >> U(8 - bit))
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ones = np.where(symbol >> U(7 - bit) & U(1), count, 0)
    total, one = np.add.reduceat(count, new), np.add.reduceat(ones, new)
    return at[new], (total - one).astype(float), one.astype(float)


class Level:
    """Nodes of one depth, sorted, with the KT probability of a one and the probability that a path ends there."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        kt, half = log_kt(n0, n1), math.log(0.5)
        self.node, self.n0, self.n1 = node, n0, n1
        self.weighted = kt if below is None else np.logaddexp(half + kt, half + below)
        self.p = (n1 + 0.5) / (n0 + n1 + 1)
        self.w = np.ones(len(node)) if below is None else np.exp(half + kt - self.weighted)

    def shorter(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, n0, n1, weight below) one byte nearer: sums over the nodes of this depth."""
        node, back = np.unique((self.node >> U(16)) << U(8) | self.node & U(255), return_inverse=True)
        return node, *(np.bincount(back, weights=x, minlength=len(node)) for x in (self.n0, self.n1, self.weighted))

    def find(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each node, whether it is there)."""
        if not len(self.node):
            return np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return at, self.node[at] == node


def shard_levels(key: np.ndarray, count: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """The levels below depth `top` of whole shards; keys are distinct and sorted."""
    if not len(key):
        return {}
    parts = [_decisions(key >> U(8), key & U(255), count, bit) for bit in range(8)]
    node, n0, n1 = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(node)
    out = {depth: Level(node[order], n0[order], n1[order], None)}
    for d in range(depth - 1, top, -1):
        out[d] = Level(*out[d + 1].shorter())
    return out


def top_levels(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, top: int) -> dict[int, Level]:
    """The levels from depth `top` up; nodes are distinct and sorted."""
    out = {top: Level(node, n0, n1, below)} if len(node) else {}
    for d in range(top - 1, -1, -1) if out else ():
        out[d] = Level(*out[d + 1].shorter())
    return out


def log10_of(key: np.ndarray, levels: dict[int, Level], depth: int) -> np.ndarray:
    """log10 probability of each key's byte after its context; levels hold all nodes on the keys' paths."""
    symbol, total = key & U(255), np.zeros(len(key))
    for bit in range(8):
        rest, mixed, last = np.ones(len(key)), np.zeros(len(key)), np.full(len(key), 0.5)
        for d in sorted(levels):
            level = levels[d]
            at, seen = level.find((key >> U(8) >> U(8 * (depth - d))) << U(8) | (U(1 << bit) | symbol >> U(8 - bit)))
            if not len(level.node):
                continue
            p, w = level.p[at], level.w[at]
            mixed += np.where(seen, rest * w * p, 0)
            rest = np.where(seen, rest * (1 - w), rest)
            last = np.where(seen, p, last)
        mixed += rest * last
        total += np.log10(np.where(symbol >> U(7 - bit) & U(1) == 1, mixed, 1 - mixed))
    return total


def _shards(batches: Iterator[pa.RecordBatch], short: int, nodes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, c, times) of whole shards, about `nodes` nodes at a time; rows come in order of their key."""
    held, size = [], 0
    for b in batches:
        held.append([b.column(0).to_numpy(zero_copy_only=False).view(U), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))])
        size += b.num_rows
        if size * 8 < nodes:
            continue
        every = [np.concatenate(x) for x in zip(*held, strict=True)]
        shard = every[0] >> U(short)
        stop = int(np.searchsorted(shard, shard[-1])) if size else 0  # the last shard may go on
        if stop:
            yield tuple(x[:stop] for x in every)
        held, size = [[x[stop:] for x in every]], size - stop
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
    trim()


def _weigh(depth: int, top: int, nodes: int):
    """(node of depth top, n0, n1, weight below) summed over the shards taken together, from (key, c, times)."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, c, _ in _shards(batches, 8 * (depth - top), nodes):
            levels = shard_levels(key[c > 0], c[c > 0], depth, top)
            if levels:
                node, *sums = levels[top + 1].shorter()
                for k in range(0, len(node), 100_000):
                    yield pa.record_batch([pa.array(x[k:k + 100_000]) for x in (node.view(np.int64), *sums)], names=["node", "n0", "n1", "below"])
    return op


def _score_grams(shared, depth: int, top: int, nodes: int):
    """(key, times, lp) from (key, c, times): the log10 probability of every gram."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = top_levels(*shared.value, top)
        for key, c, times in _shards(batches, 8 * (depth - top), nodes):
            lp = log10_of(key, upper | shard_levels(key[c > 0], c[c > 0], depth, top), depth)
            for k in range(0, len(key), 100_000):
                yield pa.record_batch([pa.array(x[k:k + 100_000]) for x in (key.view(np.int64), times, lp)], names=["key", "times", "lp"])
    return op


def gram_scores(texts: DataFrame, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """(key, times, lp) for each gram of texts (text, learn): its occurrences and the whole tree's log10 probability."""
    if not 1 <= depth <= 6:
        raise ValueError("depth is from 1 to 6")
    top = min(TOP, depth - 1)
    counted = texts.select("text", "learn").mapInArrow(_count_grams(depth), "key long, c long")
    bare = F.col("key").bitwiseAND(F.lit(UNLEARNED - 1))
    grams = cut(counted.groupBy(bare.alias("key")).agg(F.sum(F.when(F.col("key") < UNLEARNED, F.col("c")).otherwise(0)).alias("c"), F.sum("c").alias("times")))
    sharded = grams.repartition(F.shiftrightunsigned("key", 8 * (depth - top))).sortWithinPartitions("key")
    got = sharded.mapInArrow(_weigh(depth, top, nodes), "node long, n0 double, n1 double, below double").groupBy("node").agg(*(F.sum(x).alias(x) for x in ("n0", "n1", "below"))).toArrow()
    order = np.argsort(got["node"].to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast((got["node"].to_numpy().view(U)[order], *(got[x].to_numpy()[order] for x in ("n0", "n1", "below"))))
    return cut(sharded.mapInArrow(_score_grams(shared, depth, top, nodes), "key long, times long, lp double"))


class Known:
    """Log-probabilities of the grams that are broadcast, sorted; NaN for others."""

    def __init__(self, key: np.ndarray, lp: np.ndarray):
        self.key, self.lp = key, lp

    def log10(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), np.nan)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.lp[at], np.nan)


class Memory:
    """Log-probabilities already computed, one per entry; a later key replaces an earlier one."""

    def __init__(self, known: Known):
        self.known = known
        self.key, self.value = np.full(CACHE, (1 << 64) - 1, U), np.zeros(CACHE)

    def log10(self, key: np.ndarray) -> np.ndarray:
        at = (mix(key) & U(CACHE - 1)).astype(np.int64)
        out = self.value[at]
        miss = np.flatnonzero(self.key[at] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            value = np.concatenate([self.known.log10(new[k:k + 65_536]) for k in range(0, len(new), 65_536)])
            out[miss] = value[back]
            at = (mix(new) & U(CACHE - 1)).astype(np.int64)
            self.key[at], self.value[at] = new, value
        return out


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, occurrences in learning texts, in all texts), summed over a slice of text."""
    for b in slices(batches):
        w = Words(b.column(0))
        learns = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        per_word = np.repeat(learns, np.diff(w.first))
        h, back, times = np.unique(w.hashes(LOWER), return_inverse=True, return_counts=True)
        learned = np.bincount(back, weights=per_word, minlength=len(h)).astype(np.int64)
        for k in range(0, len(h), 100_000):
            yield pa.record_batch([pa.array(x[k:k + 100_000]) for x in (h.view(np.int64), learned, times.astype(np.int64))], names=["h", "c", "times"])
    trim()


def _tokens(model, common, depth: int):
    """A row for each document with its score and the sums of its common words and grams, and a row for each rare word or gram in it."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, base = common.value
        memory = Memory(Known(*model.value))
        for b in slices(batches, limit=SLICE):  # some 100 bytes of arrays for each byte of text
            ids, texts = b.column(0), b.column(1)
            rows = b.num_rows
            w = Words(texts)
            key, first = byte_stream(w, depth)
            lp = memory.log10(key)
            far = np.isnan(lp)
            rare_gram, gram_row = key[far], np.repeat(np.arange(rows), np.diff(first))[far]
            lp = np.add.reduceat(np.where(far, 0, lp), first[:-1])
            h, row = w.hashes(LOWER), w.rows()
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            at, r = at[hit], row[hit]
            sums = [np.bincount(r, weights=x[at], minlength=rows) for x in (base, (c > 0).astype(float))] if len(at) else [np.zeros(rows)] * 2
            doc = np.array([xxhash.xxh64_intdigest(t, 9) for t in texts.to_pylist()], U)
            yield _batch(doc, mix(doc), np.zeros(rows, np.int32), False, ids, b.column(2), np.diff(w.first).astype(np.int64) + 1, np.diff(first), sums[0], sums[1], lp)
            for rare, rare_row, is_gram in ((h[~hit], row[~hit], False), (rare_gram, gram_row, True)):
                if not len(rare):
                    continue
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1]))))
                tf = np.diff(np.append(new, len(rare))).astype(np.int32)
                for k in range(0, len(new), 100_000):
                    x = new[k:k + 100_000]
                    yield _batch(doc[rare_row[x]], rare[x], tf[k:k + 100_000], is_gram, ids.take(pa.array(rare_row[x])))
        del memory
        trim()
    return op


TOKEN = "doc long, h long, tf int, gram boolean, doc_id long, held_out boolean, n_tokens long, n_bytes long, base double, known double, lp double"


def _batch(doc, h, tf, gram, ids, *more) -> pa.RecordBatch:
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    rest = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(more, kinds, strict=True)] if more else [pa.nulls(len(doc), t) for t in kinds]
    return pa.record_batch([pa.array(doc.view(np.int64)), pa.array(h.view(np.int64)), pa.array(tf), pa.array(np.full(len(doc), gram)), ids, *rest], names=[x.split(" ")[0] for x in TOKEN.split(", ")])


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1


def score(docs: DataFrame, depth: int = DEPTH, most: int = GRAMS, nodes: int = NODES, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Learns from rows that are not held out.  A null text is an empty one: its
    end alone.  base_score is the smoothed unigram's, score the context tree's
    log10 probability of the text; bits_per_byte spreads that over the coded
    bytes.  `most` grams and `hot` words at most are broadcast, and a task weights
    about `nodes` nodes together; neither changes a result.  Words are told apart
    by 64-bit hashes, documents by doc_id and a hash of their text.  Rows without
    doc_id are scored and learned from.  Repeated rows are each returned.  Other
    columns are not read.  The tree is built when this is called.
    """
    sc = docs.sparkSession.sparkContext
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    words = cut(rows.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_vocabulary, "h long, c long, times long")
                .groupBy("h").agg(F.sum("c").alias("c"), F.sum("times").alias("times")))
    ends = rows.where(~F.col("held_out")).count()  # the end is a token of each learning text
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = n + ends, v + (ends > 0)
    least = _at_least(words, "times", hot)
    common = F.lit(False) if least is None else _level("times") >= least
    got = words.where(common).select("h", "c").toArrow()
    order = np.argsort(got["h"].to_numpy().view(U))
    counts = got["c"].to_numpy()[order]
    shared = sc.broadcast((got["h"].to_numpy().view(U)[order], counts, np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))))
    grams = gram_scores(rows.select("text", (~F.col("held_out")).alias("learn")), depth, nodes)
    least = _at_least(grams, "times", most)
    near = F.lit(False) if least is None else _level("times") >= least
    got = grams.where(near).select("key", "lp").toArrow()
    order = np.argsort(got["key"].to_numpy())
    model = sc.broadcast((got["key"].to_numpy().view(U)[order], got["lp"].to_numpy()[order]))
    del got
    trim()
    tokens = rows.select("doc_id", "text", "held_out").mapInArrow(_tokens(model, shared, depth), TOKEN)
    rare = (words.where(~common).select("h", F.lit(False).alias("gram"), F.col("c").alias("wc"), F.lit(None).cast("double").alias("gram_lp"))
            .unionByName(grams.where(~near).select(F.col("key").alias("h"), F.lit(True).alias("gram"), F.lit(None).cast("long").alias("wc"), F.col("lp").alias("gram_lp"))))
    met = tokens.join(rare, ["h", "gram"], "left")
    rate = lambda c: F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
    is_rare = (F.col("tf") > 0) & ~F.col("gram")
    is_gram = (F.col("tf") > 0) & F.col("gram")
    per = met.groupBy("doc_id", "doc").agg(
        *(F.max(x).alias(x) for x in ("held_out", "n_tokens", "n_bytes", "lp")), F.count("n_tokens").alias("copies"),
        F.sum(F.when(is_gram, F.col("tf") * F.col("gram_lp")).otherwise(0.0)).alias("rare_lp"),
        F.sum(F.when(is_rare, F.when(F.col("wc") > 0, F.col("tf")).otherwise(0)).otherwise(F.col("known"))).alias("known"),
        F.sum(F.when(is_rare, F.col("tf") * rate(F.col("wc"))).otherwise(F.col("base"))).alias("base"))
    per = per.withColumn("lp", F.col("lp") + F.col("rare_lp") / F.col("copies"))
    each = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id", "held_out", "n_tokens", (F.round(F.col("known") / F.col("copies")).cast("long") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + rate(F.lit(ends))).alias("base_score"), F.col("lp").alias("score"), (-F.col("lp") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
