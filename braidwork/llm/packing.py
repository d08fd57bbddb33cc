"""Best-fit packing of documents into fixed-length training sequences.

Lengths are small integers, so however large the corpus, the packing problem
is a histogram of at most `size` counts.  The driver solves that and nothing
else:

1. Patterns of two and three lengths that fill a sequence exactly are
   enumerated, and non-negative least squares fits their repeat counts to the
   histogram.
2. The counts are rounded to what the histogram still holds.
3. What is left is packed best-fit, longest first, on counts rather than on
   documents, which again gives patterns with repeat counts.

Each document then finds its place alone: the n-th piece of a length goes to
the n-th slot that the patterns have for that length.  Ranks are counted in
(length, salt) groups with the groups' offsets added, so a length that a third
of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.words import slices

SIZE, END_ID = 2048, 0
#: Shares of the fitted counts that are tried; exact fits taken early can starve the residual.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)
_encoders: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as the vocabulary file defines them, as a NumPy array of 32-bit unsigned ids.

    Byte-level BPE files whose merges are ranked by id run on tiktoken, which
    gives the same ids several times faster; other files, and texts that it
    refuses, run on tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
            merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if merged == sorted(merged) and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec.get("added_tokens", [])):
                import public_tokenizers
                import tiktoken

                back = byte_alphabet()
                ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
                self.fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001  a very long run of one character can exceed its pattern stack
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, size: int, keep_ids: bool):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            out = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(END_ID)).astype("<u4")
                n = -(-len(ids) // size)
                head = len(ids) - (n - 1) * size
                for k in range(n):
                    lo, hi = (head + (k - 1) * size if k else 0), head + k * size
                    part = ids[lo:hi]
                    for col, x in zip(out, (doc, k, lo, hi - lo, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=True):
                        col.append(x)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(out[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(cols, names=names)
    return op


def exact_patterns(hist: np.ndarray, size: int, most: int) -> list[tuple[int, ...]]:
    """Sorted length pairs that fill `size`, and the `most` triples with the largest smallest count.

    `most` bounds the least-squares problem, not what is packed.
    """
    have = np.flatnonzero(hist)
    present = np.zeros(size + 1, bool)
    present[have] = True
    out = [(size - a, a) for a in range(1, size // 2 + 1) if present[a] and present[size - a] and (a != size - a or hist[a] > 1)]
    best = []
    for a in have[have <= size // 3].tolist():  # a <= b <= c
        b = np.arange(a, (size - a) // 2 + 1)
        c = size - a - b
        ok = present[b] & present[c]
        b, c = b[ok], c[ok]
        worth = np.minimum(np.minimum(hist[b], hist[c]), hist[a])
        best.append(np.stack([np.full(len(b), a), b, c, worth]))
    if best:
        every = np.concatenate(best, axis=1)
        top = np.lexsort((every[0], every[1], -every[3]))[:most]
        out += [tuple(sorted(map(int, every[:3, i]), reverse=True)) for i in top]
    return out


def fit(patterns: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 40) -> list[float]:
    """Non-negative least squares by coordinate descent: repeat counts x with A x close to hist."""
    left = hist.astype(float).tolist()
    x = [0.0] * len(patterns)
    terms = []
    for p in patterns:
        times = defaultdict(int)
        for v in p:
            times[v] += 1
        terms.append((list(times.items()), sum(t * t for t in times.values())))
    for _ in range(sweeps):
        moved = 0.0
        for i, (parts, norm) in enumerate(terms):
            step = sum(left[v] * t for v, t in parts) / norm
            if x[i] + step < 0:
                step = -x[i]
            if step:
                x[i] += step
                moved += abs(step)
                for v, t in parts:
                    left[v] -= step * t
        if moved < 1e-3 * len(patterns):
            break
    return x


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: [(((length, times), ...), sequences)].

    Pieces of one length fill the fullest open sequence that takes them until
    it takes no more, which is what best fit does piece by piece.
    """
    spaces: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    order: list[int] = []

    def put(pattern: tuple, count: int, space: int) -> None:
        if not spaces[space]:
            bisect.insort(order, space)
        spaces[space].append((pattern, count))

    for length in range(size, 0, -1):
        count = int(hist[length])
        while count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fits = size // length
                if count >= fits:
                    put(((length, fits),), count // fits, size - fits * length)
                if count % fits:
                    put(((length, count % fits),), 1, size - count % fits * length)
                break
            space = order[at]
            pattern, open_ = spaces[space].pop()
            if not spaces[space]:
                order.pop(at)
            fits = space // length
            full = min(open_, count // fits)
            if full:
                put((*pattern, (length, fits)), full, space - fits * length)
                count -= full * fits
                open_ -= full
            if open_ and 0 < count < fits:
                put((*pattern, (length, count)), 1, space - count * length)
                open_ -= 1
                count = 0
            if open_:
                put(pattern, open_, space)
    return [x for space in list(spaces) for x in spaces[space]]


def _rounded(hist: np.ndarray, size: int, patterns: list[tuple[int, ...]], wanted: list[float]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole repeat counts that the histogram can serve, and the residual packed best-fit."""
    left = hist.astype(np.int64).copy()
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for i in sorted(range(len(patterns)), key=lambda i: -wanted[i]):
        times = defaultdict(int)
        for v in patterns[i]:
            times[v] += 1
        repeat = min(int(wanted[i] + 0.5), *(int(left[v]) // t for v, t in times.items()))
        if repeat > 0:
            made.append((tuple(times.items()), repeat))
            for v, t in times.items():
                left[v] -= repeat * t
    return made + best_fit(left, size)


def plan(hist: np.ndarray, size: int, most: int | None = None) -> np.ndarray:
    """Slots for every piece: rows (length, first rank, times, first sequence, offset), by length and rank.

    Piece number r of a length falls in the last row whose first rank is at
    most r; its sequence is first + (r - rank) // times, and its offset is
    raised by length for each earlier piece of that length in the sequence.
    """
    patterns = exact_patterns(hist, size, 4 * size if most is None else most)
    wanted = fit(patterns, hist)
    made = min((_rounded(hist, size, patterns, [x * share for x in wanted]) for share in SHARES), key=lambda m: sum(c for _, c in m))
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, repeat in made:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += repeat * times
            offset += length * times
        sequence += repeat
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(shared, size: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for b in batches:
            names = b.schema.names
            length = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(names.index("rank")).to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            inside = rank - row[:, 1]
            at = names.index("rank")
            yield pa.record_batch([*(c for i, c in enumerate(b.columns) if i != at), pa.array(row[:, 3] + inside // row[:, 2]), pa.array(row[:, 4] + inside % row[:, 2] * length)],
                                  names=[*(n for n in names if n != "rank"), "sequence_id", "offset"])
    return op


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's tokens are its ids and then id 0; a null or empty text is id 0
    alone.  Only documents above `size` are cut, into pieces of `size` of which
    the first may be shorter.  Repeated rows are packed each.  No rows give none.
    """
    spark = docs.sparkSession
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = cut(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, size, keep_ids), kind))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("c")))
    hist = np.zeros(size + 1, np.int64)
    for length, c in sizes.groupBy("length").agg(F.sum("c").alias("c")).collect():  # at most `size` rows
        hist[length] = c
    before = sizes.select("length", "salt", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = (salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
              .join(before.hint("merge"), ["length", "salt"]).withColumn("rank", (F.col("base") + F.col("n") - 1).cast("long")))
    names = [x.split(" ")[0] for x in kind.split(", ")]
    return ranked.select(*names, "rank").mapInArrow(_place(spark.sparkContext.broadcast(plan(hist, size)), size), f"{kind}, sequence_id long, offset long")
