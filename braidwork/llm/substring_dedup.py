"""Removal of repeated word sequences by prefix-partitioned suffix trees.

A window is `width` consecutive words of one document.  Every word covered by
a window whose word sequence also starts earlier - in a document with a
smaller doc_id, or earlier in the same one - is removed; windows are judged
on the input.

How it scales.  A full suffix tree over the corpus would sort every suffix.
Here only the suffixes at minimiser positions are partitioned: of the
`prefix`-word grams inside a window the one with the least hash is its
anchor, so equal windows have equal anchors and consecutive windows mostly
share one.  A run of windows with one anchor is one short row.

1. Partition by prefix.  Runs are counted by their anchor gram; prefixes that
   occur once hold no repeat and are dropped, which leaves the repeats of the
   corpus.  The counting is pre-aggregated, so a hot prefix is one row a task.
2. Subtrees.  Prefixes with up to `group_limit` runs are memory-sized: the
   suffixes of a group form one suffix tree, built from the top by comparing
   words (see maximal_repeats).  Its nodes at depth `width` and below are the
   repeats; of a repeat every occurrence but the earliest goes, as far as it
   reaches, and repeats inside longer ones need no row of their own.
3. Variable length.  Crowded prefixes are extended.  Equal runs of one need
   only the first place (a pre-aggregated minimum); the suffixes of the
   distinct ones are partitioned by a prefix
   half way to `width` words, into subtrees of their own, and where that is crowded too by `width` words,
   where a group is one node and again only its first place matters.  Nothing
   is dropped.
4. The repeats come back as word intervals of each document.  A
   document with the whole text of an earlier one skips step 2, and only the
   texts that hold some repeat are shuffled again to meet their intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import cut, small_batches
from braidwork.llm.words import Words, grams, slices, trim

WIDTH, PREFIX, GROUP_LIMIT = 20, 8, 2000


def window_runs(word_hashes: np.ndarray, first: np.ndarray, width: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: (row, start, count, prefix hash).

    `first` bounds the rows inside word_hashes; start counts from the row's first word.
    """
    none = np.empty(0, np.int64)
    g = grams(word_hashes, prefix)
    reach = width - prefix + 1
    if len(g) < reach:
        return none, none, none, np.empty(0, np.uint64)
    value, place, covered = g, np.arange(len(g)), 1
    while covered < reach:  # sliding minimum, leftmost of equals
        step = min(covered, reach - covered)
        a, b = value[:-step], value[step:]
        take = b < a
        value, place = np.where(take, b, a), np.where(take, place[step:], place[:-step])
        covered += step
    lengths = np.diff(first)
    per_row = np.maximum(lengths - width + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), per_row)
    if not len(rows):
        return none, none, none, np.empty(0, np.uint64)
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[rows]
    anchor = place[starts]
    new = np.ones(len(rows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], starts[at] - first[rows[at]], np.diff(np.append(at, len(rows))), g[anchor[at]]


def _runs(width: int, prefix: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column(1))
            row, start, n, key = window_runs(w.hashes(), w.first, width, prefix)
            if len(row):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([key.view(np.int64), ids[row], start.astype(np.int32), n.astype(np.int16)], names=["key", "doc_id", "start", "n"])
    return op


FINISHED, WAITING, SEGMENT = 0, 1, 2
#: One row of the written table: a finished document, a document that waits for its spans, or a segment.
ROW = "kind int, doc_id long, n_words long, n_removed long, kept string, text string, key long, start int, n short, seg binary, big boolean"
KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int16(), pa.binary(), pa.bool_())


def _kept(text: str | None, words: list[bytes], kept: list[bytes], keep_text: bool) -> str | None:
    """What is left of a text: itself if nothing goes, or the digest of its words."""
    if keep_text:
        return text if len(kept) == len(words) else b" ".join(kept).decode()
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _segments(width: int, keep_text: bool):
    """Documents without repeats, and copies of earlier ones, are finished here; of the others come the text and the words under each run.

    in: doc_id, text, runs, copy and further columns, which go with the document.
    """
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, source = [[] for _ in KINDS], []

            def put(at: int, *row) -> None:
                for col, x in zip(out, row, strict=True):
                    col.append(x)
                source.append(at)

            def flush() -> pa.RecordBatch:
                at = pa.array([i if k != SEGMENT else None for i, k in zip(source, out[0], strict=True)], pa.int64())
                made = pa.record_batch([*(pa.array(c, t) for c, t in zip(out, KINDS, strict=True)), *(c.take(at) for c in b.columns[4:])],
                                       names=[*(x.split(" ")[0] for x in ROW.split(", ")), *b.schema.names[4:]])
                for c in (*out, source):
                    c.clear()
                return made

            for at, (doc, text, runs, copy) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True)):
                words = (text or "").encode().split()
                if copy and len(words) >= width or not runs.is_valid:
                    kept = [] if copy and len(words) >= width else words
                    put(at, FINISHED, doc, len(words), len(words) - len(kept), _kept(text, words, kept, keep_text), None, None, None, None, None, None)
                else:
                    put(at, WAITING, doc, len(words), None, None, text, None, None, None, None, None)
                    runs = runs.values
                    for key, start, n, big in zip(*(runs.field(i).to_pylist() for i in range(4)), strict=True):
                        put(at, SEGMENT, doc, None, None, None, None, key, start, n, b" ".join(words[start:start + n + width - 1]) + b" ", big)
                if len(source) > 20_000:
                    yield flush()
            if source:
                yield flush()
    return op


def _ids(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A number for each distinct pair; both are from 0 to 2^31."""
    return pa.array(high.astype(np.int64) << 32 | low).dictionary_encode().indices.to_numpy()


def maximal_repeats(segments: pa.Array, doc: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, depth) of the repeats of at least `width` words in the suffix tree of these segments.

    segments: words, each followed by a space (binary); row i brings the
    suffixes at its first n[i] words, which stand at start[i] + offset of
    document doc[i].  The tree is built from the top, level by level, and
    words are compared themselves, not hashes of them.  The nodes at depth
    `width` come from doubling: prefixes of 2k words are numbered by the two
    numbers of their halves.  From there every node of more than one leaf is
    split by the next word.  A leaf's depth is that of the deepest node in
    which it is not the least place; offsets whose repeat lies inside that of
    the offset before are not left-maximal and left out.
    """
    w = Words(segments)
    size = np.diff(w.first)
    offsets = np.append(w.start, w.end[-1] + 1 if len(w) else 0).astype(np.int32)
    code = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(w.data)]).dictionary_encode().indices.to_numpy()
    code = np.append(code.astype(np.int64) + 1, np.zeros(width + 1, np.int64))
    end = np.append(np.repeat(w.first[1:], size), np.zeros(width + 1, np.int64))  # of the segment that a word is in
    place = np.arange(len(code))

    def longer(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
        """Numbers of prefixes of at + k words from those of `at` and of k words; one that leaves its segment equals no other that matters."""
        out = np.zeros(len(code), np.int64)
        out[:len(code) - at] = _ids(a[:len(code) - at], b[at:]) + 1
        return out

    powers, k = [code], 1
    while 2 * k <= width:
        powers.append(longer(powers[-1], powers[-1], k))
        k *= 2
    node, depth = powers[-1], k
    for e in range(len(powers) - 2, -1, -1):
        if width - depth >= 1 << e:
            node, depth = longer(node, powers[e], depth), depth + (1 << e)
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = w.first[row] + offset
    order = np.lexsort((start[row] + offset, doc[row]))  # from here on leaves are in order of their place
    row, offset, at = row[order], offset[order], at[order]
    found, leaf, node = np.zeros(len(row), np.int64), np.arange(len(row)), node[at]
    while len(leaf):
        _, first, of, many = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        later = np.ones(len(leaf), bool)
        later[first] = False
        found[leaf[later]] = depth
        deeper = (many[of] > 1) & (at[leaf] + depth < end[at[leaf]])
        leaf, of = leaf[deeper], of[deeper]
        if len(leaf):
            node = _ids(of, code[at[leaf] + depth])
        depth += 1
    order = np.lexsort((offset, row))
    row, offset, found = row[order], offset[order], found[order]
    inside = np.zeros(len(row), bool)
    inside[1:] = (row[1:] == row[:-1]) & (offset[1:] == offset[:-1] + 1) & (found[1:] < found[:-1])
    keep = (found > 0) & ~inside
    return row[keep], offset[keep], found[keep]


def _subtrees(width: int, held: int = 1 << 20):
    """(doc_id, lo, hi) from (key, doc_id, start, n, seg) in order of key: the subtrees of whole groups, about `held` bytes of words at a time."""
    def run(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        doc, start, n = (t.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
        row, offset, depth = maximal_repeats(t.column(4).chunk(0), doc, start, n, width)
        lo = start[row] + offset
        return pa.record_batch([pa.array(doc[row]), pa.array(lo.astype(np.int32)), pa.array((lo + depth).astype(np.int32))], names=["doc_id", "lo", "hi"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            rows.append(b)
            size += b.nbytes
            key = b.column(0).to_numpy()
            tail = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # the last group may go on
            if size > held and (tail or (len(rows) > 1 and rows[-2].column(0)[-1].as_py() != key[0])):
                rows[-1:] = [b.slice(0, tail)] if tail else []
                yield run(rows)
                rows, size = [b.slice(tail)], b.nbytes
        if rows:
            yield run(rows)
        trim()
    return op


def _suffixes(prefix: int, width: int):
    """(key, doc_id, start, n, seg, node) of the suffixes of segments (seg, doc_id, start): key is the hash of their first `prefix` words, node their first `width` words."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "seg", 1 << 18):  # each word is in up to `width` suffixes
            w = Words(b.column(0))
            size = np.diff(w.first)
            many = np.maximum(size - width + 1, 0)
            row = np.repeat(np.arange(b.num_rows), many)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = w.first[row] + offset
            if not len(at):
                continue
            key = grams(w.hashes(), prefix)[at]
            lo, stop, cut_at = w.start[at], w.end[w.first[row + 1] - 1] + 1, w.end[at + width - 1]
            flat = w.data.tobytes()
            pick = pa.array(row)
            for k in range(0, len(at), 20_000):
                part = slice(k, k + 20_000)
                yield pa.record_batch([pa.array(key[part].view(np.int64)), b.column(1).take(pick[part]), pa.array((b.column(2).to_numpy()[row[part]] + offset[part]).astype(np.int32)), pa.array(np.ones(len(at[part]), np.int16)),
                                       pa.array([flat[x:y] for x, y in zip(lo[part].tolist(), stop[part].tolist(), strict=True)], pa.binary()),
                                       pa.array([flat[x:y] for x, y in zip(lo[part].tolist(), cut_at[part].tolist(), strict=True)], pa.binary())], names=["key", "doc_id", "start", "n", "seg", "node"])
    return op


def _table(docs: DataFrame, extra: list[str], keep_text: bool, width: int, prefix: int, group_limit: int) -> DataFrame:
    """Steps 1 and the look-up of words for step 2, written (rows as in ROW, and `extra`)."""
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    texts = base.select("doc_id", "text").where("doc_id is not null and text is not null")
    runs = texts.mapInArrow(_runs(width, min(prefix, width)), "key long, doc_id long, start int, n short")
    # written, so that the join below is one of two plain exchanges, whose hot partitions Spark splits
    counts = cut(runs.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    wanted = (runs.join(counts, "key")
              .groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", (F.col("members") > group_limit).alias("big"))).alias("runs")))
    # all of a document that has the text of an earlier one is covered, so its runs need no further look
    digests = texts.select("doc_id", F.md5("text").alias("digest"))
    original = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    copies = digests.join(original, "digest").where("doc_id > least").select("doc_id", F.lit(True).alias("copy")).distinct()
    kind = ROW + "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in extra)
    known = base.where("doc_id is not null").join(wanted.join(copies, "doc_id", "left"), "doc_id", "left").select("doc_id", "text", "runs", "copy", *extra)
    # without an id there is nothing to join
    others = base.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(known.schema["runs"].dataType).alias("runs"), F.lit(None).cast("boolean").alias("copy"), *extra)
    return cut(known.unionByName(others).mapInArrow(_segments(width, keep_text), kind))


def _spans(table: DataFrame, width: int, prefix: int, group_limit: int) -> DataFrame:
    """(doc_id, lo, hi) from the segments of the table."""
    row, found = "doc_id long, lo int, hi int", []

    def grow(groups: DataFrame) -> None:
        found.append(groups.select("key", "doc_id", "start", "n", "seg").repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(width), row))

    segments = table.where(F.col("kind") == SEGMENT)
    grow(segments.where("not big"))
    place = F.struct("doc_id", "start")
    large = segments.where("big").select("doc_id", "start", "n", "seg")
    leaves = cut(large.groupBy("seg").agg(F.min(place).alias("least")))  # written, as the counts are
    found.append(large.join(leaves, "seg").where(place != F.col("least")).select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (width - 1)).cast("int").alias("hi")))
    # what differs between the segments of a crowded prefix: their suffixes, by a longer prefix and, where that is crowded too, by all of a node's words
    longer = (min(prefix, width) + width) // 2
    suffixes = leaves.select("seg", "least.doc_id", "least.start").mapInArrow(_suffixes(longer, width), "key long, doc_id long, start int, n short, seg binary, node binary")
    sizes = cut(suffixes.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    grow(suffixes.join(sizes.where(F.col("members") <= group_limit), "key"))
    nodes = suffixes.join(sizes.where(F.col("members") > group_limit), "key").select("node", "doc_id", "start")
    first = cut(nodes.groupBy("node").agg(F.min(place).alias("least"), F.count("*").alias("c")).where("c > 1").select("node", "least"))
    found.append(nodes.join(first, "node").where(place != F.col("least")).select("doc_id", F.col("start").alias("lo"), (F.col("start") + width).cast("int").alias("hi")))
    made = found[0]
    for f in found[1:]:
        made = made.unionByName(f)
    return made


def repeats(docs: DataFrame, width: int = WIDTH, prefix: int = PREFIX, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, lo, hi): word intervals covered by windows that start earlier elsewhere.

    docs needs doc_id (integer) and text.  Null texts, empty texts and texts
    of fewer than `width` words have no window; rows without doc_id have no
    place in the order and are not judged.  Intervals may overlap.
    """
    table = _table(docs, [], False, width, prefix, group_limit)
    whole = table.where((F.col("kind") == FINISHED) & (F.col("n_removed") > 0)).select("doc_id", F.lit(0).alias("lo"), F.col("n_words").cast("int").alias("hi"))
    return whole.unionByName(_spans(table, width, prefix, group_limit))


def _apply(keep_text: bool):
    """in: doc_id, text, spans and further columns."""
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, removed, left = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                words = (text or "").encode().split()
                kept = words
                if spans.is_valid and len(spans.values):
                    change = np.zeros(len(words) + 1, np.int64)
                    lo, hi = (np.minimum(spans.values.field(i).to_numpy(zero_copy_only=False), len(words)) for i in (0, 1))
                    np.add.at(change, lo, 1)
                    np.add.at(change, hi, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                left.append(_kept(text, words, kept, keep_text))
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string()), *b.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *b.schema.names[3:]])
    return op


def _applied(docs: DataFrame, extra: list[str], keep_text: bool, width: int = WIDTH, prefix: int = PREFIX, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_words, n_removed, kept and extra for every row of docs; only texts with repeats meet their spans."""
    table = _table(docs, extra, keep_text, width, prefix, group_limit)
    spans = _spans(table, width, prefix, group_limit).groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    columns = ["doc_id", "n_words", "n_removed", "kept", *extra]
    kind = "doc_id long, n_words long, n_removed long, kept string" + "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in extra)
    waiting = table.where(F.col("kind") == WAITING).join(spans, "doc_id", "left").select("doc_id", "text", "spans", *extra).mapInArrow(_apply(keep_text), kind)
    return table.where(F.col("kind") == FINISHED).select(*columns).unionByName(waiting)


def dedup_substrings(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    A null text counts as one without words.  Other columns are not read.  Rows
    that repeat a doc_id with the same text are one document and each returned.
    The table of segments is written when this is called.
    """
    return _applied(docs, [], False, **how).withColumnRenamed("kept", "kept_sha256")


def rewrite_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, n_chars) with repeats taken out; other columns go.

    Texts that lose nothing stay as they are; the others become their kept
    words joined by single spaces, with n_chars to match.
    """
    return _applied(docs, ["lang", "source", "n_chars"], True, **how).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


#: The same in DuckDB SQL over `documents`, by windows spelled out.
ORACLE = """
WITH d AS (SELECT doc_id, [w for w in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''] AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM later),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM places p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.pos = p.pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""
