"""Benchmark decontamination: near matches of benchmark items inside documents.

A document is contaminated by an item if some word window of it is within
`ratio` x (words of the item) word edits of the item.  Words are runs of
letters and digits, A-Z lower-cased, so punctuation and spacing do not count;
in scripts without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each
character is a word.  Items of fewer than MIN_WORDS words match without edits:
their words are looked up as one gram and compared.

1. CGK embedding.  A random walk over a window writes the word it stands on
   and moves on by a random bit of (step, word), so that windows within few
   edits write the same words at most steps: edit distance becomes Hamming
   distance.  The walks from all positions of a text are computed together,
   from the last step back.
2. Bit-sampling LSH.  A table compares SAMPLED steps of one walk.  A window has
   6, 12, 24 or 48 words, the largest that an item holds twice (6 for the
   shortest items); every window of an item is in the tables, and the window
   from every position of every document is looked up.  What meets names an
   item and where it would start.
3. Exact verification by the edit distance of the item to the best substring
   around that start.

How many tables an item needs is measured, not assumed: random edits of random
items of its size, as many as `ratio` allows, are looked up until a share
`recall` of them is found (see tables_for).  Pairs with fewer edits are found
more often, copies always.

How it scales.  One pass over the documents without a shuffle.  The items are
broadcast in blocks of at most `block_bytes`, so the benchmark may be larger
than memory; each block is a pass of its own, and a worker builds the tables
of a block once.  Items with the same words are one in the tables.  What a
text meets there is verified in pieces of PIECE.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import small_batches
from braidwork.llm.words import ALNUM, LOWER, U, Words, grams, mix, slices

RATIO, MIN_WORDS = 0.2, 6
#: Items with fewer bytes of letters and digits (eight Latin letters, three Chinese characters) are no evidence of a leak.
MIN_BYTES = 8
RECALL, SAMPLED, SIZES = 0.995, 4, (6, 12, 24, 48)
#: Random items of each size on which the number of tables is measured, and the most tables.
TRIALS, MOST_TABLES = 300, 64
BLOCK_BYTES, PIECE, SPAN = 4 << 20, 4096, 1 << 14
V = np.uint32


#: First two bytes of characters that are words of their own: Thai and Lao, Burmese, Khmer, kana and bopomofo, Han.
_ALONE = np.zeros((256, 256), bool)
for _lead, _from, _to in ((0xE0, 0xB8, 0xBB), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xE3, 0x81, 0x84), (0xE3, 0x90, 0xBF), (0xEF, 0xA4, 0xAB), (0xF0, 0xA0, 0xB3)):
    _ALONE[_lead, _from:_to + 1] = True
_ALONE[0xE4:0xEA, 0x80:0xC0] = True
#: Punctuation of these scripts, which separates.
_MARKS = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in [*range(0x3000, 0x3004), *range(0x3008, 0x3020), 0x3030, 0x30FB, *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF66)]))


def tokens(text: pa.Array) -> Words:
    """Words of letters and digits; characters of scripts without spaces are words of their own."""
    w = Words(text, ALNUM)
    at = np.flatnonzero(w.data >= 0xE0)
    at = at[at + 2 < len(w.data)]
    if not len(at):
        return w
    lead, second, third = (w.data[at + i].astype(np.int64) for i in range(3))
    mark = np.isin(lead << 16 | second << 8 | third, _MARKS)
    some = _ALONE[lead, second] | mark
    marks, at, size = at[mark], at[some], np.where(lead[some] >= 0xF0, 4, 3)
    if not len(at):
        return w
    cuts = np.unique(np.concatenate([at, at + size]))
    word = np.searchsorted(w.start, cuts, side="right") - 1
    cuts = cuts[(word >= 0) & (cuts > w.start[word]) & (cuts < w.end[word])] if len(w) else cuts[:0]
    start, end = np.sort(np.concatenate([w.start, cuts])), np.sort(np.concatenate([w.end, cuts]))
    keep = ~np.isin(start, marks)
    w.start, w.end = start[keep], end[keep]
    w.first = np.searchsorted(w.start, w.offsets)
    return w


def steps(size: int) -> int:
    """Steps of a walk over a window; a walk moves on at half of them."""
    return size * 3 // 2


def allowed(size: int, ratio: float) -> int:
    """Edits allowed to an item of `size` words."""
    return int(size * ratio + 1e-9) if size >= MIN_WORDS else 0


def window_size(words: int) -> int:
    """Words of the windows of an item: the largest of SIZES that it holds twice, the smallest for short items."""
    return max([s for s in SIZES if 2 * s <= words], default=SIZES[0])


@functools.cache
def sampled(size: int, table: int) -> tuple[tuple[int, int], ...]:
    """(step, odd factor) of each sampled step, one from each of SAMPLED equal parts of the walk."""
    rng = np.random.default_rng([size, table])
    cuts = [math.ceil(i * steps(size) / SAMPLED) for i in range(SAMPLED + 1)]
    return tuple((int(rng.integers(a, max(a + 1, b))), int(rng.integers(0, 1 << 31)) * 2 + 1) for a, b in zip(cuts, cuts[1:], strict=False))


def embed(words: np.ndarray, size: int, table: int) -> np.ndarray:
    """A 32-bit hash of the sampled steps of the table's walk from each position of words.

    Computed from the last step to the first: what a walk at a position writes
    from a step on is what it writes there and what the walk at the next or at
    the same position writes from the following step on.  A walk that leaves
    its text or item reads on in the next one, as it reads on inside a text.
    """
    places = dict(sampled(size, table))
    last = max(places)
    moves = mix(words + U((table + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    symbol = mix(words ^ U(0x5DEECE66D)).astype(V)
    out = np.zeros(len(words), V)
    for at in range(0, len(words), SPAN):  # blocks that stay in cache
        own = slice(at, min(len(words), at + SPAN + last))
        m, s = moves[own], symbol[own]
        half = [(m & U(0xFFFFFFFF)).astype(V), (m >> U(32)).astype(V)]
        h = np.zeros(len(s) + 1, V)
        for j in range(last, -1, -1):
            if j < last:
                on = V(0) - (half[j // 32 % 2] >> V(j % 32) & V(1))
                h[:-1] ^= (h[1:] ^ h[:-1]) & on
            if j in places:
                h[:-1] += s * V(places[j])
        out[at:at + SPAN] = h[:min(SPAN, len(words) - at)]
    return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words after random substitutions, deletions and insertions."""
    out = words.tolist()
    for kind, at in zip(rng.integers(0, 3, edits).tolist(), rng.random(edits).tolist(), strict=True):
        i = int(at * len(out))
        if kind == 1:
            del out[i]
        else:
            out[i:i + (kind == 0)] = [int(rng.integers(1 << 62))]
    return np.array(out, U)


@functools.cache
def tables_for(words: int, edits: int, recall: float) -> int:
    """Tables in which a share `recall` of random items of so many words is found again after so many random edits."""
    rng = np.random.default_rng([words, edits])
    size, reach = window_size(words), 2 * window_size(words)
    items = rng.integers(0, 1 << 62, (TRIALS, words + reach)).astype(U)
    texts = [np.concatenate([edited(x[:words], edits, rng), rng.integers(0, 1 << 62, reach).astype(U)]) for x in items]
    first = np.cumsum([0, *(len(t) for t in texts)])
    flat, left = np.concatenate(texts), np.ones(TRIALS, bool)
    for t in range(MOST_TABLES):
        mine, theirs = embed(items.ravel(), size, t).reshape(items.shape)[:, :max(1, words - size + 1)], embed(flat, size, t)
        for k in np.flatnonzero(left).tolist():
            left[k] = not np.isin(theirs[first[k]:first[k + 1] - reach], mine[k]).any()
        if left.sum() <= (1 - recall) * TRIALS:
            return t + 1
    return MOST_TABLES


class Table:
    """Windows of items by the hash of one table."""

    def __init__(self, key: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.key, self.at, self.times = np.unique(key[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 20, bool)  # a first look that most positions fail
        self.filter[self.key >> V(12)] = True

    def meet(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, offset in the item) of what the keys meet, piece by piece."""
        some = np.flatnonzero(self.filter[key >> V(12)])
        found = np.minimum(np.searchsorted(self.key, key[some]), len(self.key) - 1)
        hit = self.key[found] == key[some]
        some, found = some[hit], found[hit]
        bounds = np.flatnonzero(np.diff(np.cumsum(self.times[found]) // (PIECE * 64), prepend=0)).tolist()
        for lo, hi in zip([0, *bounds], [*bounds, len(some)], strict=True):
            if lo < hi:
                times = self.times[found[lo:hi]]
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.at[found[lo:hi]], times)
                yield np.repeat(some[lo:hi], times), self.item[entry], self.offset[entry]


class Items:
    """The items of one block as word hashes, and the tables of their windows; items with the same words are one."""

    def __init__(self, ids: list[int], texts: list[str], ratio: float, tables_of: dict[int, int]):
        w = tokens(pa.array(texts, pa.string()))
        h = w.hashes(LOWER)
        same: dict[bytes, list[int]] = {}
        for k, i in enumerate(ids):
            same.setdefault(h[w.first[k]:w.first[k + 1]].tobytes(), []).append(i)
        self.ids = list(same.values())
        self.words = [np.frombuffer(x, U) for x in same]
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.edits = np.array([allowed(n, ratio) for n in self.sizes.tolist()], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, U)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by words: (grams of the whole items, sorted, and their items)
        for size in np.unique(self.sizes[(self.sizes > 0) & (self.sizes < MIN_WORDS)]).tolist():
            some = np.flatnonzero(self.sizes == size)
            whole = np.concatenate([grams(self.words[i], size) for i in some.tolist()])
            order = np.argsort(whole, kind="stable")
            self.short[size] = (whole[order], some[order])
        long = np.flatnonzero(self.sizes >= MIN_WORDS)
        windows = np.array([window_size(n) for n in self.sizes.tolist()])
        tables = np.array([tables_of.get(n, 0) for n in self.sizes.tolist()])
        self.tables: list[tuple[int, int, Table]] = []  # (words of the windows, number of the table, the table)
        for size in np.unique(windows[long]).tolist():
            mine = long[windows[long] == size]
            for t in range(int(tables[mine].max())):
                some = mine[tables[mine] > t]
                many = self.sizes[some] - size + 1
                item, offset = np.repeat(some, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                self.tables.append((size, t, Table(embed(self.flat, size, t)[self.first[item] + offset], item, offset)))


def fit_distances(item: np.ndarray, text: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Least edits from each column of item to any substring of the same column of text, where outside is not text."""
    ramp = np.arange(len(text) + 1, dtype=np.int16)[:, None]
    row = np.zeros((len(text) + 1, text.shape[1]), np.int16)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + ((text != x) | outside), row[1:] + np.int16(1), out=new[1:])
        new -= ramp
        row = np.minimum.accumulate(new, axis=0) + ramp
    return row.min(0)


def exact(w: Words, h: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """Like matches(), for the items of fewer than MIN_WORDS words."""
    for size, (whole, item) in items.short.items():
        gram = grams(h, size)
        lo, hi = np.searchsorted(whole, gram, side="left"), np.searchsorted(whole, gram, side="right")
        at = np.flatnonzero(hi > lo)
        row = np.searchsorted(w.first, at, side="right") - 1
        found = set()
        for r, a in zip(row.tolist(), at.tolist(), strict=True):
            if a + size <= w.first[r + 1]:  # not across documents
                found |= {(r, i) for i in item[lo[a]:hi[a]].tolist() if (items.words[i] == h[a:a + size]).all()}
        for r, i in sorted(found):
            for k in items.ids[i]:
                yield r, k, 0, size


def verify(h: np.ndarray, first: np.ndarray, items: Items, met: np.ndarray, best: dict[tuple[int, int], int]) -> None:
    """Put the edits of candidates (columns: row, item, start in h) that are few enough into best."""
    met = np.unique(met, axis=1)
    for size in np.unique(items.sizes[met[1]]).tolist():
        same = met[:, items.sizes[met[1]] == size]
        most = int(items.edits[same[1, 0]])
        for at in range(0, same.shape[1], PIECE):
            row, item, start = part = same[:, at:at + PIECE]
            if best:
                part = part[:, [best.get(x, 1) > 0 for x in zip(row.tolist(), item.tolist(), strict=True)]]
                row, item, start = part
            place = start + np.arange(-most, size + most)[:, None]
            outside = (place < first[row]) | (place >= first[row + 1])
            d = fit_distances(items.flat[items.first[item] + np.arange(size)[:, None]], h[np.clip(place, 0, len(h) - 1)], outside)
            for k in np.flatnonzero(d <= most).tolist():
                pair = int(row[k]), int(item[k])
                best[pair] = min(best.get(pair, most), int(d[k]))


def matches(text: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item_id, edits, words of the item) for each row of text and item that matches it."""
    w = tokens(text)
    h = w.hashes(LOWER)
    yield from exact(w, h, items)
    best: dict[tuple[int, int], int] = {}
    held, size = [], 0
    row_of = w.rows()
    for words, t, table in items.tables if len(h) else ():
        for position, item, offset in table.meet(embed(h, words, t)):
            held.append(np.stack([row_of[position], item, position - offset]))
            size += len(position)
            if size > PIECE * 64:
                verify(h, w.first, items, np.concatenate(held, axis=1), best)
                held, size = [], 0
    if held:
        verify(h, w.first, items, np.concatenate(held, axis=1), best)
    for (r, i), d in sorted(best.items()):
        for k in items.ids[i]:
            yield r, k, d, int(items.sizes[i])


_built: dict[str, Items] = {}


def _items(shared) -> Items:
    """The tables of a broadcast block, built once by a worker."""
    name, *block = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Items(*block)
    return _built[name]


def _scan(shared):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared)
        for b in slices(batches):
            got = list(matches(b.column(1), items))
            if got:
                ids = b.column(0).to_pylist()
                yield pa.record_batch([pa.array([ids[r] for r, *_ in got], pa.int64()), *(pa.array([x[k] for x in got], pa.int64() if k == 1 else pa.int32()) for k in (1, 2, 3))],
                                      names=["doc_id", "item_id", "edits", "item_words"])
    return op


def _keep_clean(shared):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared)
        for b in slices(batches):
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, *_ in matches(b.column(b.schema.get_field_index("text")), items)]] = False
            yield b.filter(pa.array(keep))
    return op


def _item_blocks(benchmark: DataFrame, ratio: float, recall: float, block_bytes: int) -> Iterator:
    """Broadcast item blocks of about block_bytes at most: a name, and what Items takes."""
    if not 0 <= ratio <= 0.3:
        raise ValueError("ratio is from 0 to 0.3")
    spark = benchmark.sparkSession
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    total = usable.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    numbered = usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        rows = numbered.where(F.col("block") == k).select("item_id", "text").distinct().orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            w = tokens(rows["text"].combine_chunks().cast(pa.string()))
            total = np.concatenate(([0], np.cumsum(w.end - w.start)))[w.first]
            rows = rows.filter(pa.array(np.diff(total) >= MIN_BYTES))
            tables = {n: tables_for(n, allowed(n, ratio), recall) for n in np.unique(np.diff(w.first)).tolist() if n >= MIN_WORDS}
        if rows.num_rows:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, rows["item_id"].to_pylist(), rows["text"].to_pylist(), ratio, tables))


def contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, item_words): items found in documents, with the edits of the best match tried.

    Items of fewer than MIN_WORDS words match exactly.  Those with fewer than
    MIN_BYTES bytes of letters and digits, null or empty ones included, are no
    evidence of a leak and are left out; so are null and empty documents, which
    hold no window.  Repeated rows give repeated results; other columns are not
    read.  The benchmark's blocks are gathered when this is called.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    made = None
    for shared in _item_blocks(benchmark, ratio, recall, block_bytes):
        part = texts.mapInArrow(_scan(shared), "doc_id long, item_id long, edits int, item_words int")
        made = part if made is None else made.unionByName(part)
    return made if made is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, item_words int")


def clean_documents(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in whose text no item is found, with all columns; null texts are clean."""
    small_batches(docs)
    for shared in _item_blocks(benchmark, ratio, recall, block_bytes):
        docs = docs.mapInArrow(_keep_clean(shared), docs.schema)
    return docs
