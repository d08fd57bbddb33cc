"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors of a label become one row with their number, by a
   pre-aggregated group; a group of copies of any size is one row from there.
2. A rotation of the principal components is learned so that signs balance
   and quantise well (ITQ), on a bounded sample: the SAMPLE distinct vectors
   of each dimension with the least hash.  Every vector is indexed.
3. A code is cut into chunks, wider the more vectors a label has.  Two codes
   within RADIUS bits have a chunk within RADIUS // chunks bits, so each code
   waits under its own chunk and looks under the neighbouring ones.  At the
   threshold a bit differs with a chance of some 6 %, so of 64 bits 4 do.
   Codes that meet are candidates if they differ in ACCEPT bits at most, which
   those within RADIUS do that meet for certain, and others that meet by chance.
4. Vectors follow only where there is a candidate, and are compared by cosine
   in double precision.  A crowded bucket is split into pairs of blocks, so no
   task holds more than two.  What comes back are link counts for each vector
   and a spanning forest of the links, never all pairs; a pair that meets in
   several tables counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.components import components
from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.words import mix, trim

COSINE, SAMPLE, ROUNDS, RADIUS, ACCEPT, BLOCK = 0.98, 10_000, 40, 7, 14, 1024
U = np.uint64


def learn_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): ITQ on rows of unit vectors, to `bits` signs."""
    mean = x.mean(0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    principal = vectors[:, ::-1][:, :bits]
    v = (x - mean) @ principal
    r = np.linalg.qr(np.random.default_rng(0).standard_normal((bits, bits)))[0]
    for _ in range(rounds if len(x) > 1 else 0):
        b = np.where(v @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        r = (left @ right).T
    return mean, principal @ r


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (x - mean) @ projection > 0
    out = np.zeros(len(x), U)
    for i in range(signs.shape[1]):
        out |= signs[:, i].astype(U) << U(i)
    return out


def layout(bits: int, vectors: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """((shift, width) of each chunk, bits in which a chunk may differ).

    vectors: the most of one label.  Chunks are as wide as leaves some 16 of
    them in a bucket, from 8 to 16 bits.
    """
    width = min(bits, max(8, min(16, round(math.log2(max(2, vectors))) - 4)))
    n = max(1, bits // width)
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], radius // n


def _codes(shared):
    """(node, lab, dim, copies, code) from (node, lab, dim, copies, embedding)."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy()
            code = np.zeros(b.num_rows, U)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                mean, projection, _ = shared.value[dim]
                code[rows] = encode(unit(_matrix(b.column(4).take(pa.array(rows)))), mean, projection)
            yield pa.record_batch([*b.columns[:4], pa.array(code.view(np.int64))], names=["node", "lab", "dim", "copies", "code"])
    return op


#: What an entry is, in one number: the vector's size, the table, and whether it waits there (1) or looks (0).
def pack(dim: int, table: int, home: bool) -> int:
    return dim << 16 | table << 1 | home


def _lookups(shared, radius: int):
    """A row for each bucket that a vector waits in or looks into: (bucket, kind, node, lab, code) from (node, lab, dim, code)."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                node, lab, size, codes = (c.to_numpy() for c in b.columns)
                for dim in np.unique(size).tolist():
                    mine = np.flatnonzero(size == dim)
                    code = codes[mine].view(U)
                    chunks, near = layout(min(dim, 64), shared.value[dim], radius)
                    who, key, kind = [], [], []
                    for t, (shift, width) in enumerate(chunks):
                        own = code >> U(shift) & U((1 << width) - 1)
                        for flips in range(near + 1):
                            for places in combinations(range(width), flips):
                                to = own ^ U(sum(1 << p for p in places))
                                ok = np.flatnonzero(to >= own)  # of two chunks, the smaller looks under the larger
                                who.append(ok)
                                key.append(mix(lab[mine[ok]].view(U) ^ mix(to[ok] << U(8) | U(t))))
                                kind.append(np.full(len(ok), pack(dim, t, flips == 0)))
                    who = mine[np.concatenate(who)]
                    yield pa.record_batch([pa.array(x) for x in (np.concatenate(key).view(np.int64), np.concatenate(kind), node[who], lab[who], codes[who])], names=["bucket", "kind", "node", "lab", "code"])
    return op


class Meeting:
    """Which pairs of entries of a bucket are candidates there: within `accept` bits, one of them at home, and in no table before."""

    def __init__(self, sizes: dict[int, int], radius: int, accept: int):
        self.sizes, self.radius, self.accept = sizes, radius, accept

    def near(self, kind_a: np.ndarray, lab_a: np.ndarray, code_a: np.ndarray, kind_b: np.ndarray, lab_b: np.ndarray, code_b: np.ndarray) -> np.ndarray:
        """For arrays that broadcast against each other."""
        differ = code_a ^ code_b
        ok = (np.bitwise_count(differ) <= self.accept) & (lab_a == lab_b) & ((kind_a | kind_b) & 1 == 1)
        at = np.nonzero(ok)
        if len(at[0]):
            differ = differ[at]
            kind = np.broadcast_to(kind_a, ok.shape)[at]
            first = np.ones(len(differ), bool)
            for dim in np.unique(kind >> 16).tolist():
                chunks, near = layout(min(dim, 64), self.sizes[dim], self.radius)
                for t, (shift, width) in enumerate(chunks[:-1]):
                    later = (kind >> 16 == dim) & (kind >> 1 & 0x7FFF > t)
                    first &= ~later | (np.bitwise_count(differ >> U(shift) & U((1 << width) - 1)) > near)
            ok[at] = first
        return ok


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows in order of their first column, in tables of some `rows` rows that no value of it is divided between."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        tail = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # the last group may go on
        if sum(x.num_rows for x in held) + tail >= rows and (tail or held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, b.slice(0, tail)]).combine_chunks()
            held, b = [], b.slice(tail)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


TILE = 1024


def _blocks(lo: int, hi: int) -> Iterator[tuple[slice, slice]]:
    """Tiles that cover the pairs i <= j of a group."""
    for i in range(lo, hi, TILE):
        for j in range(i, hi, TILE):
            yield slice(i, min(hi, i + TILE)), slice(j, min(hi, j + TILE))


def _active(shared, radius: int, accept: int, dense: int = 32):
    """The entries that are a candidate's, from (part, bucket, kind, node, lab, code) in order of part; codes alone are compared."""
    def run(t: pa.Table) -> pa.RecordBatch:
        part, bucket, kind, node, lab, code = (t.column(i).to_numpy() for i in range(6))
        code = code.view(U)
        meeting = Meeting(shared.value, radius, accept)
        active = np.zeros(len(part), bool)
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        size = np.diff(bounds)
        for k in np.flatnonzero(size > dense).tolist():
            for a, b in _blocks(int(bounds[k]), int(bounds[k + 1])):
                ok = meeting.near(kind[a, None], lab[a, None], code[a, None], kind[None, b], lab[None, b], code[None, b])
                if a == b:
                    np.fill_diagonal(ok, False)
                active[a] |= ok.any(1)
                active[b] |= ok.any(0)
        for step in range(1, min(dense, len(part))):  # small groups together
            at = np.flatnonzero(part[step:] == part[:-step])
            at = at[np.repeat(size <= dense, size)[at]] if len(at) else at
            if not len(at):
                break
            to = at + step
            ok = meeting.near(kind[at], lab[at], code[at], kind[to], lab[to], code[to])
            active[at[ok]] = active[to[ok]] = True
        pick = np.flatnonzero(active)
        return pa.record_batch([pa.array(x[pick]) for x in (bucket, kind, node, lab)], names=["bucket", "kind", "node", "lab"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 20_000):
            yield run(t)
        trim()
    return op


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the links (a, b)."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := above.get(x, x)) != x:
            above[x] = above.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compare(shared, radius: int, accept: int, cosine: float):
    """(rep, other, links), a link or a count of links, from (part, kind, rep, lab, code, copies, block, embedding) in order of part."""
    def group(t: pa.Table, meeting: Meeting) -> Iterator[pa.RecordBatch]:
        kind, rep, lab, code, copies, block = (t.column(i).to_numpy() for i in range(1, 7))
        code, x = code.view(U), unit(_matrix(t.column(7).chunk(0)))
        who, other, links = [], [], []
        for a, b in _blocks(0, len(rep)):
            ok = meeting.near(kind[a, None], lab[a, None], code[a, None], kind[None, b], lab[None, b], code[None, b])
            if a == b:
                ok = np.triu(ok, 1)
            if block[0] >= 0:  # two blocks: pairs inside one are another part's
                ok &= block[a, None] != block[None, b]
            i, j = np.nonzero(ok)
            near = np.einsum("ij,ij->i", x[a][i], x[b][j]) >= cosine if len(i) < TILE else (x[a] @ x[b].T)[i, j] >= cosine
            i, j = i[near] + a.start, j[near] + b.start
            for p, q in spanning(rep[i], rep[j]):
                who.append(p)
                other.append(q)
                links.append(0)
            ends, back = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
            who += ends.tolist()
            other += [None] * len(ends)
            links += np.bincount(back, weights=np.concatenate([copies[j], copies[i]]), minlength=len(ends)).astype(np.int64).tolist()
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (who, other, links)], names=["rep", "other", "links"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(shared.value, radius, accept)
        for t in whole_groups(batches, 2048):
            part = t.column(0).to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    yield from group(t.slice(lo, hi - lo).combine_chunks(), meeting)
        trim()
    return op


def _parted(entries: DataFrame, limit: int, *columns: str) -> DataFrame:
    """(part, block, columns) of entries in order of their part: a bucket, or of one with over `limit` entries a pair of blocks; block is -1 where all of a part is compared."""
    crowded = cut(entries.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > limit))
    if crowded.isEmpty():
        placed = entries.select(F.col("bucket").alias("part"), F.lit(-1).alias("block"), *columns)
    else:
        blocks = F.coalesce(F.ceil(2 * F.col("members") / limit).cast("int"), F.lit(1))
        placed = entries.join(crowded, "bucket", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
        placed = placed.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(pair).alias("part"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("block"), *columns)
    return placed.repartition("part").sortWithinPartitions("part")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, radius: int = RADIUS, accept: int = ACCEPT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Labels are of any type; vectors are floats or doubles, and other numbers
    are taken as doubles.  Vectors without label, or null, empty, zero or with
    a component that is null or not finite, link with nothing, and neither do
    vectors of different length.  Rows without vec_id link with nothing and are
    kept.  Rows that repeat a vec_id are vectors of their own, of one component
    and with the sum of their links.  Other columns are not read.  The index is
    built when this is called.
    """
    sc = vectors.sparkSession.sparkContext
    element = vectors.schema["embedding"].dataType.simpleString()
    kind = element if element in ("array<float>", "array<double>") else "array<double>"
    e = F.col("embedding")
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    plain = F.transform(e, lambda x: x + F.lit(0.0).cast(kind[6:-1]))  # one zero, not two
    keyed = (base.withColumn("good", good).withColumn("lab", F.when(F.col("good"), F.xxhash64(F.size(e), "label")))
             .withColumn("k1", F.when(F.col("good"), F.xxhash64(F.lit(1), plain))).withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(2), F.size(e), plain))))
    key = ["lab", "k1", "k2"]
    distinct = cut(keyed.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("vec_id", "embedding")).alias("v"))
                   .select(*key, "rep", "copies", F.size("v.embedding").alias("dim"), F.col("v.embedding").alias("embedding")))
    models = {}
    by_label = distinct.groupBy("dim", "lab").count()
    for dim, n, most in by_label.groupBy("dim").agg(F.sum("count"), F.max("count")).collect():
        # a cut by hash first, so that little more than the sample is ordered
        some = distinct.where(F.col("dim") == dim).where(F.shiftrightunsigned("k1", 1) <= min(2**63 - 1, 2**63 * 2 * sample // n))
        rows = some.select("k1", "k2", "embedding").orderBy("k1", "k2").limit(sample).toArrow()["embedding"]
        rows = rows if len(rows) else distinct.where(F.col("dim") == dim).select("embedding").limit(1).toArrow()["embedding"]
        models[dim] = (*learn_rotation(unit(_matrix(rows.combine_chunks())), min(dim, 64)), most)
    sizes = sc.broadcast({dim: m[2] for dim, m in models.items()})
    # codes alone are shuffled to the tables; vectors only follow those that have a candidate
    coded = cut(distinct.select(F.col("k1").alias("node"), "lab", "dim", "copies", "embedding").mapInArrow(_codes(sc.broadcast(models)), "node long, lab long, dim int, copies long, code long"))
    entry = "bucket long, kind long, node long, lab long"
    looks = coded.select("node", "lab", "dim", "code").mapInArrow(_lookups(sizes, radius), entry + ", code long")
    parts = _parted(looks, 8 * block, "bucket", "kind", "node", "lab", "code").drop("block")
    active = cut(parts.mapInArrow(_active(sizes, radius, accept), entry).distinct())
    vector = distinct.select(F.col("k1").alias("node"), "lab", "rep", "embedding").join(coded.select("node", "lab", "copies", "code"), ["node", "lab"])
    met = _parted(active, block, "kind", "node", "lab")
    full = met.join(vector, ["node", "lab"]).select("part", "kind", "rep", "lab", "code", "copies", "block", "embedding")
    found = cut(full.repartition("part").sortWithinPartitions("part").mapInArrow(_compare(sizes, radius, accept, cosine), "rep long, other long, links long"))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    by_rep = distinct.select(*key, "rep", "copies").join(counts, "rep", "left").join(groups, "rep", "left")
    near = by_rep.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    return (keyed.select("vec_id", *key).join(near, key, "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


#: The exact result in DuckDB SQL over `embeddings` by comparing all pairs of a label; the index may miss links of it.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a) USING (vec_id) LEFT JOIN (SELECT node AS vec_id, min(c) AS c FROM r GROUP BY node) USING (vec_id)"""
