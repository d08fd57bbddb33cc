"""SimHash near-duplicates at a similarity of word shingles: the search of simhash.py at a wider radius.

A text is the set of its shingles of SHINGLE words (A-Z lower-cased; one
shingle of all words if there are fewer); two texts link at a Jaccard
similarity of SIMILARITY or more.

1. Fingerprints.  A set has ROUNDS SimHash fingerprints of 64 bits, from
   independent hashes of its shingles, and a code of 128 more bits.  At a
   similarity of 0.8 some 15 % of the bits differ, about ten of 64, which is
   too far for one fingerprint to be found by its guaranteed radius.
2. Search.  Each fingerprint is embedded as the bit counts of its two-bit
   segments and joined on the grid of either half (see simhash.py): two sets
   are candidates where the counts of a half are within a Manhattan distance
   of 2, the lower bound of the Hamming distance, and the codes within BITS.
   A round finds 28 % of the pairs at 0.8 and half of those at 0.87; the ROUNDS
   find 97 %, and 99 % from 0.83 on (tests measure it).
3. Verification.  Candidates are settled by the exact similarity of their sets.

How it scales.  Equal sets become one row by a pre-aggregated minimum.  A round
is one shuffle of 50 visits of 32 bytes (40 after the first round) for each
distinct set, whose files go before the next; of small tables several rounds
are one shuffle.  Candidates come as stars that connect what a batch of visits
links, never all pairs.  What the first round connects has one label from then
on, and the other rounds give links between labels only, so a large group is
not spanned anew in every cell and round.  The components of the candidates
are clusters, so that every candidate pair is inside a cluster, and only the
shingles of clusters are shuffled, once.  A cluster yields a spanning forest of
its verified links.  A cluster with many shingles is compared by pairs of
blocks, in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.components import components
from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.simhash import CELL_LIMIT, crowded, grid_links, hamming
from braidwork.llm.words import LOWER, U, Words, grams, mix, slices, trim

SHINGLE, SIMILARITY, ROUNDS, RADIUS, BITS = 5, 0.8, 10, 4, 32
#: Visits that one job shuffles at most; a single round may be more.
VISITS = 1 << 25
#: Words of 64 bits of the code that candidates are compared by.
CODE = 2
#: Shingles of one cluster that are compared together; larger clusters are split into pairs of blocks.
CLUSTER_LIMIT = 1 << 21
SLICE = 1 << 20
_SALT = np.random.default_rng(11).integers(0, 1 << 64, ROUNDS + CODE, dtype=U)


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each row's distinct shingles, sorted; first of each row and the end); an empty text has the hash zero."""
    w = Words(text)
    h, n = w.hashes(LOWER), np.diff(w.first)
    many = np.maximum(n - shingle + 1, 1)
    row = np.repeat(np.arange(len(n)), many)
    at = w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    value = np.zeros(len(row), U)
    for k in range(1, shingle + 1):
        some = n[row] >= k if k == shingle else n[row] == k
        if some.any():
            value[some] = grams(h, k)[at[some]]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def fingerprints(value: np.ndarray, first: np.ndarray, salts: np.ndarray = _SALT) -> np.ndarray:
    """A row of SimHash words for each set of hashes: a bit is 1 if set in over half of the salted hashes."""
    n = np.diff(first)
    pieces = -(-n // 255)  # bytes count to 255
    piece_first = np.cumsum(pieces) - pieces
    starts = first[:-1].repeat(pieces) + 255 * (np.arange(pieces.sum()) - piece_first.repeat(pieces))
    out = np.zeros((len(n), len(salts)), U)
    for k, salt in enumerate(salts):
        h = mix(value ^ salt)
        for i in range(8):  # bit i of every byte, eight counts at once
            ones = np.add.reduceat(h >> U(i) & U(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(ones.astype(np.int64), piece_first, axis=0)
            for byte in range(8):
                out[:, k] |= (2 * ones[:, byte] > n).astype(U) << U(8 * byte + i)
    return out


def set_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(value + U(0x9E3779B97F4A7C15)), first[:-1]))


def _longs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _sketch(shingle: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            value, first = shingle_sets(b.column(1), shingle)
            fps = fingerprints(value, first)
            yield pa.record_batch([b.column(0), pa.array(set_keys(value, first).view(np.int64)), pa.array(np.diff(first).astype(np.int64)), _longs(fps.ravel(), np.arange(b.num_rows + 1) * fps.shape[1])],
                                  names=["doc_id", "set", "n", "fps"])
    return op


def _sets(shingle: int):
    """(cluster, blocks, set, code, shingles) from (text, cluster, blocks)."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            value, first = shingle_sets(b.column(0), shingle)
            code = fingerprints(value, first, _SALT[ROUNDS:])
            yield pa.record_batch([b.column(1), b.column(2), pa.array(set_keys(value, first).view(np.int64)), _longs(code.ravel(), np.arange(b.num_rows + 1) * CODE), _longs(value, first)],
                                  names=["cluster", "blocks", "set", "code", "shingles"])
    return op


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def forest(code: list[np.ndarray], sets: list[np.ndarray], least: float, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets whose codes are within `bits` (positions)."""
    left, links = np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = hamming([c[left] for c in code], [c[at] for c in code]) <= bits
            near[near] = [similar(sets[at], sets[x], least) for x in left[near].tolist()]
            found = left[near].tolist()
            left = left[~near]
            queue += found
            links += [(at, x) for x in found]
    return links


def _verify(least: float, bits: int):
    """(x, y) from rows (part, set, code, shingles) that come in order of their part."""
    def run(t: pa.Table) -> Iterator[tuple[int, int]]:
        part, key = (t.column(i).to_numpy() for i in (0, 1))
        code = t.column(2).combine_chunks().flatten().to_numpy().view(U).reshape(-1, CODE).T
        shingles = t.column(3).combine_chunks()
        value, first = shingles.flatten().to_numpy().view(U), np.concatenate(([0], np.cumsum(shingles.value_lengths().to_numpy())))
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = lo + np.unique(key[lo:hi], return_index=True)[1]
            for a, b in forest([c[own] for c in code], [value[first[i]:first[i + 1]] for i in own.tolist()], least, bits):
                yield int(key[own[a]]), int(key[own[b]])

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["x", "y"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0).to_numpy()
            tail = int(np.searchsorted(part, part[-1]))
            if tail or (held and held[-1].column(0)[-1].as_py() != part[0]):  # what is held and what precedes the tail are whole
                yield out(list(run(pa.Table.from_batches([*held, b.slice(0, tail)]))))
                held = []
            held.append(b.slice(tail))
        if held:
            yield out(list(run(pa.Table.from_batches(held))))
        trim()
    return op


def every_of(distinct: DataFrame, *columns, first: int = 0, many: int = ROUNDS) -> DataFrame:
    """A row (grid, fp, columns) for the fingerprint of each set in each of `many` rounds from `first` on."""
    some = distinct.select(F.posexplode(F.slice("fps", first + 1, min(many, ROUNDS - first))).alias("grid", "fp"), *columns)
    return some.withColumn("grid", F.col("grid") + first)


def groups(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, limit: int = CLUSTER_LIMIT, cell_limit: int = CELL_LIMIT, bits: int = BITS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable) for every row with doc_id.

    Null and empty texts equal one another.  Other columns are not read.  The
    rounds run when this is called.
    """
    rows = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(rows.mapInArrow(_sketch(shingle), "doc_id long, set long, n long, fps array<long>"))
    distinct = cut(sketched.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fps").alias("fps")))
    big = cut(crowded(every_of(distinct), RADIUS, cell_limit))
    big = None if big.isEmpty() else big
    nodes = ["set", *(f"code{i}" for i in range(CODE))]
    words = [F.col("fps")[ROUNDS + i].alias(f"code{i}") for i in range(CODE)]
    each = max(1, VISITS // (50 * max(1, distinct.count())))  # how many rounds are one job changes no result
    first = cut(grid_links(every_of(distinct, "set", *words, many=1), nodes, RADIUS, bits, big))
    met = cut(components(first.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("x"), F.col("component").alias("y")))
    labelled = cut(distinct.join(met.select(F.col("x").alias("set"), F.col("y").alias("label")), "set", "left").select("set", "fps", F.coalesce("label", "set").alias("label")))
    for k in range(1, ROUNDS, each):
        coded = every_of(labelled, "set", *words, "label", first=k, many=each)
        met = met.unionByName(cut(grid_links(coded, [*nodes, "label"], RADIUS, bits, big, labelled=True)))
    clusters = cut(components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("set"), F.col("component").alias("cluster")))
    members = clusters.join(distinct.select("set", "rep", "n"), "set")
    sized = members.groupBy("cluster").agg(F.ceil(F.sum("n") / limit).cast("int").alias("blocks"))
    suspects = members.join(sized, "cluster").select(F.col("rep").alias("doc_id"), "cluster", "blocks")
    sets = rows.join(suspects, "doc_id").select("text", "cluster", "blocks").mapInArrow(_sets(shingle), "cluster long, blocks int, set long, code array<long>, shingles array<long>")
    own, other = F.expr("pmod(set, blocks)"), F.col("other")
    parted = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("cluster", F.least(own, other), F.greatest(own, other)).alias("part"), "set", "code", "shingles")
    links = cut(parted.repartition("part").sortWithinPartitions("part").mapInArrow(_verify(least, bits), "x long, y long").distinct())
    ends = distinct.select("set", "rep")
    edges = (links.join(ends.select(F.col("set").alias("x"), F.col("rep").alias("a")), "x")
             .join(ends.select(F.col("set").alias("y"), F.col("rep").alias("b")), "y").select("a", "b"))
    found = components(edges).withColumnRenamed("node", "rep")
    named = distinct.join(found, "rep", "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    return sketched.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, limit: int = CLUSTER_LIMIT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with all columns.

    Rows that repeat a kept doc_id are all kept; rows without doc_id are kept.
    """
    gone = groups(docs, shingle, least, limit).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
