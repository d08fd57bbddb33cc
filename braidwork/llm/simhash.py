"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprint: A-Z lower-cased, words, shingles of `shingle` words (repeats
included); a bit is 1 if set in over half of the shingles' XXH64 (seed 42).
Fingerprints link at `distance` or fewer differing bits.

Search.  A fingerprint is embedded as the bit counts of its 32 two-bit
segments.  Flipping a bit moves one count by one, so the Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints.  With
16 segments in either half, linked fingerprints differ by at most
distance // 2 in one half.  The range join runs on the unit grid of each
half: every fingerprint visits the cells within half that radius, rounded up,
and two fingerprints in range always share a cell.  Fingerprints in a cell
are verified on all 64 bits.

How it scales.  Equal fingerprints (exact copies, or empty texts) become one
row before the join, by a pre-aggregated minimum.  Links are given as stars
that connect what a batch of cells links, never all pairs; in a dense cell the
search from a member only looks at members not yet reached, so such a cell
costs little more than its size.  A
crowded cell is compared by pairs of blocks of a fixed size, in tasks of their
own; together their stars connect what the cell connects.  Components are
found by distributed star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.components import components
from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.words import slices, trim

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of one cell that are compared together; larger cells are split into pairs of blocks.
CELL_LIMIT = 1 << 16
U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes.lower() maps A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist(), strict=False)), dtype="<u8", count=len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=U)
            yield pa.record_batch([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])
    return op


def counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed two bits each."""
    return fp - ((fp >> U(1)) & U(0x5555555555555555))


def _steps(radius: int) -> list[tuple[tuple[int, int], ...]]:
    """Moves of at most `radius` unit steps, on distinct or equal axes, in 16 dimensions."""
    units = [(axis, sign) for axis in range(16) for sign in (1, -1)]
    moves = {(): None}
    for _ in range(radius):
        for m in list(moves):
            for axis, sign in units:
                at = dict(m)
                at[axis] = at.get(axis, 0) + sign
                moves[tuple(sorted((a, d) for a, d in at.items() if d))] = None
    return list(moves)


def homes(fp: np.ndarray, grid: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The grid cell of each fingerprint in either half; the half is bit 32, the number of the grid above it."""
    embedded, above = counts(fp), np.asarray(grid).astype(U) << U(33)
    return tuple((embedded >> U(32 * half)) & U(0xFFFFFFFF) | U(half) << U(32) | above for half in (0, 1))


def around(cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into cell, cell): the cells within the radius of each cell, itself included."""
    index, out = [], []
    for move in _steps(radius):
        ok, to = np.ones(len(cell), bool), cell
        for axis, by in move:
            value = ((cell >> U(2 * axis)) & U(3)).astype(np.int64) + by
            ok &= (value >= 0) & (value <= 2)
            to = (to & U(~(3 << (2 * axis)) & (1 << 64) - 1)) | (np.clip(value, 0, 3).astype(U) << U(2 * axis))
        index.append(np.flatnonzero(ok))
        out.append(to[ok])
    return np.concatenate(index), np.concatenate(out)


def reach(distance: int) -> int:
    """How far from its own cell a fingerprint has to visit in either half."""
    return (distance // 2 + 1) // 2


def cells(fp: np.ndarray, distance: int, grid: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, cell): the grid cells that each fingerprint visits in both halves."""
    got = [around(h, reach(distance)) for h in homes(fp, grid)]
    return np.concatenate([i for i, _ in got]), np.concatenate([c for _, c in got])


def _count_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cell, c = np.unique(np.concatenate(homes(b.column(0).to_numpy(zero_copy_only=False).view(U), b.column(1).to_numpy())), return_counts=True)
        yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(c.astype(np.int64))], names=["cell", "c"])


def _spread(distance: int):
    """(cell, visits) from heavy home cells (cell, c)."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1).to_numpy(zero_copy_only=False)
            index, cell = around(b.column(0).to_numpy(zero_copy_only=False).view(U), reach(distance))
            yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(c[index])], names=["cell", "c"])
    return op


def crowded(codes: DataFrame, distance: int, limit: int) -> DataFrame:
    """(cell, blocks): the cells with over `limit` visits from heavy home cells (fp, grid), and in how many blocks to compare them.

    A home is heavy with limit / moves fingerprints (fp), so a cell that is not
    listed has at most 2 x limit visits, and a block at most about limit / 2.
    """
    moves = len(_steps(reach(distance)))
    heavy = codes.select("fp", "grid").mapInArrow(_count_homes, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).where(F.col("c") >= max(1, limit // moves))
    big = heavy.mapInArrow(_spread(distance), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).where(F.col("c") > limit)
    return big.select("cell", (2 * F.ceil(F.col("c") / limit)).cast("int").alias("blocks"))


def _visit(distance: int):
    """(cell, what follows) for every cell that a row (fp, grid, ...) visits."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                index, cell = cells(part.column(0).to_numpy(zero_copy_only=False).view(U), distance, part.column(1).to_numpy())
                pick = pa.array(index)
                yield pa.record_batch([pa.array(cell.view(np.int64)), *(c.take(pick) for c in part.columns[2:])], names=["cell", *part.schema.names[2:]])
    return op


def hamming(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(a ^ b).astype(np.int64) for a, b in zip(x, y, strict=True))


def forest(code: list[np.ndarray], distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among codes (positions); a code is one or more words."""
    left, links = np.arange(len(code[0])), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = hamming([c[left] for c in code], [c[at] for c in code]) <= distance
            found = left[near].tolist()
            if found:
                left = left[~near]
                queue += found
                links += [(at, x) for x in found]
    return links


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, node) for every node of the links (a, b) but the least of its component: as many links as connect the same."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    top = np.arange(len(ids))
    while True:
        low, high = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(top, high[apart], low[apart])
        while (top[top] != top).any():
            top = top[top]
    other = np.flatnonzero(top != np.arange(len(ids)))
    return ids[top[other]], ids[other]


def _verify(distance: int, dense: int = 48, labelled: bool = False):
    """(x, y) from rows (part, node, words of its code) in order of part; without words the node is its code.  Small parts are compared together, offset by offset.

    What the links of a batch connect is given as stars, so a row gives one link at most.
    labelled: a label follows the code, and x and y are labels; links inside a label are left out.
    """
    def run(part: np.ndarray, node: np.ndarray, code: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        size = np.diff(bounds)
        for k in np.flatnonzero(size > dense):
            own = bounds[k] + np.unique(node[bounds[k]:bounds[k + 1]], return_index=True)[1]
            links = forest([c[own] for c in code], distance)
            if links:
                x = np.array(links)
                p, q = label[own[x[:, 0]]], label[own[x[:, 1]]]
                a.append(p[p != q])
                b.append(q[p != q])
        keep = np.repeat((size <= dense) & (size > 1), size)
        part, label, code = part[keep], label[keep], [c[keep] for c in code]
        for step in range(1, min(dense, max(1, len(part)))):
            same = part[step:] == part[:-step]
            if not same.any():
                break
            x, y = label[:-step][same], label[step:][same]
            near = (hamming([c[:-step][same] for c in code], [c[step:][same] for c in code]) <= distance) & (x != y)
            a.append(x[near])
            b.append(y[near])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, U), np.empty(0, U))

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        part, node, *code = (np.concatenate(x) for x in zip(*held, strict=True))
        label = code.pop() if labelled else node
        a, b = run(part, node, code or [node], label)
        if len(a):
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in stars(a, b)], names=["x", "y"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).view(U) for c in batch.columns]
            part = columns[0]
            tail = int(np.flatnonzero(part != part[-1])[-1]) + 1 if part[0] != part[-1] else 0  # the last part may go on
            if held and (tail or held[-1][0][-1] != part[0]):
                yield from flush([*held, [c[:tail] for c in columns]])
                held = []
            elif tail:
                yield from flush([[c[:tail] for c in columns]])
            held.append([c[tail:] for c in columns])
        if held:
            yield from flush(held)
        trim()
    return op


def grid_links(codes: DataFrame, nodes: list[str], distance: int, bits: int, big: DataFrame | None, labelled: bool = False) -> DataFrame:
    """(x, y): stars that connect what the links among codes (fp, grid, and the columns `nodes`) that share a cell connect.

    Fingerprints fp are joined on the grid within `distance`; a link is at most
    `bits` differing bits of the codes, which are the columns of `nodes` after
    the first, or the first itself.  big has the crowded cells, if there are any.
    labelled: the last of `nodes` names what is already connected; links are
    then between labels, and only between different ones.
    """
    visits = codes.select("fp", "grid", *nodes).mapInArrow(_visit(distance), "cell long, " + ", ".join(f"{n} long" for n in nodes))
    if big is None:
        parted = visits.withColumnRenamed("cell", "part")
    else:
        own, other = F.pmod(F.xxhash64(nodes[0]), F.col("blocks")), F.col("other")
        placed = visits.join(big, "cell", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        parted = placed.select(F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least(own, other), F.greatest(own, other))).alias("part"), *nodes)
    return parted.repartition("part").sortWithinPartitions("part").mapInArrow(_verify(bits, labelled=labelled), "x long, y long")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def fingerprint_groups(fps: DataFrame, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of fps (doc_id, fp)."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    codes = distinct.select("fp", F.lit(0).alias("grid"), F.col("fp").alias("node"))
    big = cut(crowded(codes, distance, cell_limit))
    links = grid_links(codes, ["node"], distance, distance, None if big.isEmpty() else big).distinct()
    ends = distinct.where("rep is not null")
    edges = (links.join(ends.select(F.col("fp").alias("x"), F.col("rep").alias("a")), "x")
             .join(ends.select(F.col("fp").alias("y"), F.col("rep").alias("b")), "y").select("a", "b"))
    found = components(edges).withColumnRenamed("node", "rep")
    return distinct.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) for every row.

    Null and empty texts have fingerprint zero and link like any other.  Rows
    without doc_id get the component of their fingerprint; where no row of the
    component has one it is null.  Other columns are not read.  The search runs
    when this is called.
    """
    if distance < 0 or distance > 8:
        raise ValueError("distance is from 0 to 8")
    fps = cut(fingerprints(docs, shingle))
    groups = fingerprint_groups(fps, distance)
    return fps.join(groups, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with all columns.

    Rows that repeat a kept doc_id are all kept; rows without doc_id are kept.
    """
    gone = near_duplicates(docs, shingle, distance).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
