import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import packing as m
from braidwork.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, tokenizer, size):
    by, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(ids) and all(r.length == size for r in mine[1:])
        at = 0
        for r in mine:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
    return len(by)


@pytest.mark.parametrize("size", [64, 2048])
def test_pieces_and_places(documents, tokenizer, size):
    rows = m.pack(documents, tokenizer_path(), size).collect()
    used = check(rows, [(r.doc_id, r.text) for r in documents.collect()], tokenizer, size)
    assert used <= 1.02 * sum(r.length for r in rows) / size + 1


def test_odd_rows(odd, tokenizer):
    odd = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(m.pack(odd, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in odd.collect()], tokenizer, 2048)


def test_repeated_rows_and_null_ids(odd):
    rows = m.pack(odd, tokenizer_path()).where("doc_id = 8 or doc_id is null").collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_ids_round_trip(documents, tokenizer):
    row = m.pack(documents, tokenizer_path(), keep_ids=True).orderBy("doc_id").first()
    text = documents.where(f"doc_id = {row.doc_id}").first().text
    assert tokenizer.decode(row.ids[:-1], skip_special_tokens=False) == text


def test_empty(empty):
    assert m.pack(empty, tokenizer_path()).count() == 0


def test_plan_uses_every_slot_once():
    rng = random.Random(2)
    for size in (10, 50):
        for _ in range(20):
            hist = np.zeros(size + 1, np.int64)
            for _ in range(rng.randrange(1, 400)):
                hist[rng.randrange(1, size + 1)] += rng.choice([1, 1, 5])
            rows = m.plan(hist, size)
            filled = defaultdict(int)
            for length in np.flatnonzero(hist).tolist():
                mine = rows[rows[:, 0] == length]
                for r in range(hist[length]):
                    row = mine[np.searchsorted(mine[:, 1], r, side="right") - 1]
                    filled[row[3] + (r - row[1]) // row[2]] += length
            assert max(filled.values()) <= size
            total = int((hist * np.arange(size + 1)).sum())
            assert len(filled) <= 11 / 9 * -(-total // size) + 1 or len(filled) <= sum(c for _, c in m.best_fit(hist, size))


def test_least_squares_fits_an_exact_mixture():
    hist = np.zeros(11, np.int64)
    hist[[7, 3]] = 40
    hist[10] = 5
    assert m.fit([(7, 3)], hist) == pytest.approx([40.0])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aA1 \n\t'.,é你\u00a0\u2028<|>"))), max_size=120))
def test_ids_are_those_of_the_file(text):
    """The faster encoder gives the ids that tokenizers gives."""
    from tokenizers import Tokenizer

    if not hasattr(test_ids_are_those_of_the_file, "slow"):
        test_ids_are_those_of_the_file.slow = Tokenizer.from_file(tokenizer_path())
    assert m.encoder(tokenizer_path())(text).tolist() == test_ids_are_those_of_the_file.slow.encode(text, add_special_tokens=False).ids


def test_ids_of_documents(documents, tokenizer):
    for r in documents.collect():
        assert m.encoder(tokenizer_path())(r.text or "").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids
