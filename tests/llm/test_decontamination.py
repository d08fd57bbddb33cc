import random
import re

import numpy as np
import pytest

from braidwork.llm import decontamination as m


def tokens(text):
    return re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode().lower())


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"zz{rng.randrange(99)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"qq{rng.randrange(99)}")
    return words


@pytest.fixture(scope="module")
def planted(spark, sf, documents):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hosts = [r.text.split()[:200] for r in documents.limit(40).collect()]
    rows = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        host = rng.choice(hosts)
        at = rng.randrange(len(host) + 1)
        rows.append((k, " ".join([*host[:at], *edited(words, rng.randrange(int(len(words) * 0.3) + 1), rng), *host[at:]]).upper()))
    return items, rows


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_matches_brute_force(spark, planted, block):
    items, rows = planted
    want = {}
    for doc, text in rows:
        for item, own in items:
            words = tokens(own)
            d = plain_distance(words, tokens(text))
            if d <= int(0.2 * len(words) + 1e-9):
                want[doc, item] = d
    got = m.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert {(r.doc_id, r.item_id): r.edits for r in got.collect()} == want
    assert len(want) > 20


def test_clean_documents(spark, planted, documents, sf):
    items, rows = planted
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hit = {r.doc_id for r in m.contaminated(documents, benchmark).collect()}
    clean = m.clean_documents(documents, benchmark)
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in documents.collect()} - hit


def test_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "the cat sat on the mat the"), (4, "on the mat the cat sat on the")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in m.contaminated(odd, items).collect()} == {(7, 4, 0), (8, 4, 0)}
    assert m.contaminated(odd, items.where("item_id < 4")).count() == 0
    assert m.contaminated(empty, items).count() == 0
    assert m.clean_documents(odd, items).count() == odd.count() - 3


def test_walks_are_those_of_one_position_at_a_time():
    """The walks computed together against each walked alone."""
    rng = np.random.default_rng(0)
    words = rng.integers(0, 40, 300).astype(np.uint64)
    for size, table in ((6, 0), (24, 3), (48, 1)):
        places, last = dict(m.sampled(size, table)), max(dict(m.sampled(size, table)))
        moves = m.mix(words + np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).tolist()
        symbol = m.mix(words ^ np.uint64(0x5DEECE66D)).tolist()
        got = m.embed(words, size, table)
        for start in range(0, 300, 7):
            at, h = start, 0
            for j in range(last + 1):
                if at < 300 and j in places:
                    h += (symbol[at] & 0xFFFFFFFF) * places[j]
                if at < 300:
                    at += moves[at] >> (32 * (j // 32 % 2) + j % 32) & 1
            assert got[start] == h & 0xFFFFFFFF


def test_blocks_do_not_change_walks(monkeypatch):
    words = np.random.default_rng(1).integers(0, 99, 1000).astype(np.uint64)
    want = m.embed(words, 24, 2)
    monkeypatch.setattr(m, "SPAN", 64)
    assert (m.embed(words, 24, 2) == want).all()


@pytest.mark.parametrize("words", [6, 9, 15, 23, 24, 40, 64])
def test_recall_at_the_threshold(spark, words):
    """Items with as many edits as are allowed are found; 0.9 at least is asked for."""
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(800)]
    items = [(k, [rng.choice(vocabulary) for _ in range(words)]) for k in range(60)]
    rows = [(k, " ".join([*(rng.choice(vocabulary) for _ in range(30)), *edited(own, int(words * 0.2), rng), *(rng.choice(vocabulary) for _ in range(30))])) for k, own in items]
    want = {k for (k, own), (_, text) in zip(items, rows, strict=True) if plain_distance([x.encode() for x in own], tokens(text)) <= int(words * 0.2)}
    got = m.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(own)) for k, own in items], "item_id long, text string"))
    assert len({r.doc_id for r in got.collect() if r.doc_id == r.item_id} & want) >= 0.95 * len(want)


def test_edit_distances_against_the_plain_recurrence():
    rng = np.random.default_rng(3)
    item, text = rng.integers(0, 4, (7, 200)), rng.integers(0, 4, (12, 200))
    outside = np.zeros(text.shape, bool)
    outside[9:, ::2] = True
    got = m.fit_distances(item, text, outside)
    assert got.tolist() == [plain_distance(item[:, k].tolist(), text[:9 if k % 2 == 0 else 12, k].tolist()) for k in range(200)]


def test_items_of_one_template(spark):
    """Many items that share most of their words, and items with the same words."""
    items = [(i, "which of the following statements about the element is correct answer " + f"n{i // 2}") for i in range(400)]
    docs = [(1, items[7][1] + " and more"), (2, "nothing of that")]
    got = {(r.doc_id, r.item_id): r.edits for r in m.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, i): (0 if i in (6, 7) else 1) for i in range(400)}


def test_clashing_columns(spark, documents):
    bench = spark.createDataFrame([(1, "the cat sat on the mat the")], "item_id long, text string").selectExpr("*", "1 as edits", "2 as doc_id")
    docs = spark.createDataFrame([(1, "THE cat, sat on the mat. The end")], "doc_id long, text string").selectExpr("*", "1 as item_id", "3 as edits", "4 as item_words")
    assert [tuple(r) for r in m.contaminated(docs, bench).collect()] == [(1, 1, 0, 7)]
    assert m.clean_documents(docs, bench).count() == 0


def test_ratio_is_checked(documents):
    with pytest.raises(ValueError):
        m.contaminated(documents, documents.selectExpr("doc_id as item_id", "text"), ratio=0.5)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Boiling point, argon?"), (2, "photosynthesis"), (3, "水的沸点在标准大气压下是多少摄氏度"), (4, "ประเทศไทย"), (5, "日本の首都はどこですか。"), (6, "yes"), (7, "水的沸点在标准大气压下是多少摄氏度呢还有冰点")]
    docs = [(1, "its boiling POINT argon has"), (2, "boiling argon point"), (3, "Photosynthesis."), (4, "photosynthesise, yes"), (5, "前言。水的沸点在标准大气压下是多少摄氏度？后记"),
            (6, "前言水的沸点在标准大气压是多少华氏度后记"), (7, "ฉันรักประเทศไทยมาก"), (8, "問題:日本の首都は、どこですか"), (9, "boiling point"), (10, "argon"), (11, "水的冰点"), (12, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.item_words) for r in m.contaminated(df, bench).collect()}
    assert got == {(1, 1): (0, 3), (3, 2): (0, 1), (5, 3): (0, 17), (6, 3): (2, 17), (7, 4): (0, 9), (8, 5): (0, 11)}
    assert {r.doc_id for r in m.clean_documents(df, bench).collect()} == {2, 4, 9, 10, 11, 12}
