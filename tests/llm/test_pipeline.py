import re
import sys
from collections import Counter
from pathlib import Path

from tokenizers import Tokenizer

import corpus_pipeline as p
from braidwork.llm import langid
from braidwork.llm.queries import tokenizer_path
from braidwork.llm.scratch import cut

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_langid import plain_choice  # noqa: E402
from test_packing import check  # noqa: E402
from test_simhash_similarity import brute as near_copies  # noqa: E402


LOWER = {c: c + 32 for c in range(65, 91)}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def words_of(text):
    return [w.translate(LOWER) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]


def leaks(text, items):
    """Whether an item is in the text within a fifth of its words; only texts with enough of its words are compared."""
    words = words_of(text)
    have = Counter(words)
    for item in items:
        own = words_of(item)
        most = int(0.2 * len(own) + 1e-9)
        if sum((have & Counter(own)).values()) >= len(own) - most and distance(own, words) <= most:
            return True
    return False


def without_repeats(docs):
    """doc_id -> text without the windows of 20 words that start earlier."""
    seen, out = {}, {}
    for doc in sorted(docs):
        words, gone = (docs[doc].text or "").encode().split(), set()
        for i in range(len(words) - 19):
            if seen.setdefault(tuple(words[i:i + 20]), (doc, i)) != (doc, i):
                gone.update(range(i, i + 20))
        out[doc] = b" ".join(w for i, w in enumerate(words) if i not in gone).decode() if gone else docs[doc].text
    return out


def test_each_stage_against_brute_force(spark, sf, documents):
    """Every stage on what the one before it kept, held against plain Python."""
    after, docs = [documents], documents
    for name, stage in p.STAGES:
        docs = cut(stage(spark, docs, sf))
        after.append(docs)
        if name != "packing":
            assert docs.columns == documents.columns, name
    given, known, distinct, rewritten, clean, packed = (x.collect() if k == 5 else rows(x) for k, x in enumerate(after))

    model = langid.fit(documents.where(~langid.held_out()).select("text", "lang"))
    for doc, r in given.items():
        if not any(map(str.isalpha, r.text or "")):
            assert doc not in known
        elif doc % 8 == 0:
            assert known[doc].lang == model.languages[plain_choice(model, r.text)[0][0]]
        else:
            assert known[doc].lang in model.languages
    assert all(known[doc].text == given[doc].text for doc in known)

    want = set(near_copies({i: r.text for i, r in known.items()}).values())
    assert want <= set(distinct) <= set(known) and len(set(distinct) - want) <= 0.03 * len(known)
    assert all(distinct[doc] == known[doc] for doc in distinct)

    texts = without_repeats(distinct)
    assert {i: r.text for i, r in rewritten.items()} == texts
    assert all(r.n_chars == (len(r.text) if r.text != distinct[i].text else distinct[i].n_chars) for i, r in rewritten.items())

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, r in rewritten.items() if not leaks(r.text or "", items)}
    assert all(clean[i] == rewritten[i] for i in clean) and 0 < len(clean) < len(given)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    check(packed, [(i, r.text) for i, r in clean.items()], tokenizer, 2048)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in p.run(spark, sf).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_odd_documents(spark, sf, odd, empty):
    """Clashing columns in the first stage's input do no harm: it returns those of documents."""
    docs = odd.selectExpr("*", "1 as n", "2 as set", "3 as fps", "4 as kind", "5 as cluster")
    for _, stage in p.STAGES:
        docs = cut(stage(spark, docs, sf))
    assert docs.count() > 0
    for _, stage in p.STAGES:
        empty = cut(stage(spark, empty, sf))
    assert empty.count() == 0


def test_entry_registers_everything():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and e.oracle_sql().keys() <= names.keys()
