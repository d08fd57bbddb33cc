import zlib

import numpy as np
import pyarrow as pa

from braidwork.llm import langid as m


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = m.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_labels_of_held_out_rows_are_not_used(documents):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(m.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    plain = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in m.identify(documents).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in m.identify(other).collect()} == plain


def test_mixture_finds_both_languages(spark, documents):
    rows = documents.where("length(text) > 1500").collect()
    one = {lang: next(r.text for r in rows if r.lang == lang) for lang in ("en", "de")}
    labelled = m.fit(documents.select("text", "lang"))
    text = pa.array([one["en"][:900] + "\n" + one["de"][:900], one["en"]], pa.string())
    _, sets, share, _ = m.infer(labelled.log_p, text)
    names = [[labelled.languages[k] for k in s] for s in sets]
    assert set(names[0]) == {"en", "de"} and names[1] == ["en"]
    assert 0.3 < share[0, labelled.languages.index("de")] < 0.7


def test_em_matches_a_plain_loop(documents):
    model = m.fit(documents.select("text", "lang"))
    text = documents.limit(3).toArrow()["text"].combine_chunks()
    bucket, begin, w = m.trigrams(text)
    each = np.add.reduceat(model.log_p[bucket], begin, axis=0).astype(float)
    _, _, _, every = m.infer(model.log_p, text)
    for i in range(len(text)):
        words = each[w.first[i]:w.first[i + 1]]
        share = np.full(words.shape[1], 1 / words.shape[1])
        for _ in range(m.ROUNDS):
            part = np.maximum(np.exp(words - words.max(1, keepdims=True)), 1e-30) * share
            share = (part / part.sum(1, keepdims=True)).mean(0)
        assert np.allclose(share, every[i])


def test_odd_rows(odd):
    got = m.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for d in (1, 2, 3, 10):
        assert (by[d].lang_pred, by[d].score, by[d].languages) == ("und", 0.0, [])
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)


def test_nothing_to_learn_from(empty, documents, spark):
    assert m.identify(empty).count() == 0
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in m.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_relabel_documents(odd, documents):
    assert m.relabel_documents(documents).columns == documents.columns
    assert m.relabel_documents(documents).count() == documents.count()
    assert not {1, 2, 3, 10} & {r.doc_id for r in m.relabel_documents(odd).collect()}


def plain_choice(model, text):
    """(languages by falling share, shares over all languages) of one text, in plain loops."""
    import math

    bucket, begin, w = m.trigrams(pa.array([text]))
    words = np.add.reduceat(model.log_p[bucket], begin, axis=0).astype(float).tolist()
    floor = 1e-30

    def em(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(model.languages))]
        for _ in range(m.ROUNDS):
            total = [0.0] * len(share)
            for x in words:
                part = [max(math.exp(v - max(x)), floor) * s for v, s in zip(x, share, strict=True)]
                total = [t + p / sum(part) for t, p in zip(total, part, strict=True)]
            share = [t / len(words) for t in total]
        return share, sum(math.log(sum(max(math.exp(v - max(x)), floor) * s for v, s in zip(x, share, strict=True))) + max(x) for x in words)

    every, _ = em(set(range(len(model.languages))))
    single = [sum(math.log(max(math.exp(x[k] - max(x)), floor)) + max(x) for x in words) for k in range(len(model.languages))]
    chosen = {max(range(len(single)), key=lambda k: (single[k], -k))}
    share, reached = [float(k in chosen) for k in range(len(single))], max(single)
    while len(chosen) < len(single):
        joins = next(k for k in sorted(range(len(single)), key=lambda k: (-every[k], k)) if k not in chosen)
        if every[joins] * len(words) < 1:
            break
        trial, total = em(chosen | {joins})
        if total - reached <= m.PENALTY * math.log(max(len(words), 2)):
            break
        chosen, share, reached = chosen | {joins}, trial, total
    return sorted(chosen, key=lambda k: (-share[k], k)), every


def test_the_set_of_languages_is_that_of_plain_loops(documents):
    model = m.fit(documents.select("text", "lang"))
    rows = [r.text for r in documents.orderBy("doc_id").limit(25).collect()]
    texts = [t[:1500] for t in rows] + [a[:300] + " " + b[:200] for a, b in zip(rows, rows[7:], strict=False)] + ["the", "und der die"]
    _, sets, _, every = m.infer(model.log_p, pa.array(texts))
    for text, got, share in zip(texts, sets, every, strict=True):
        want, plain = plain_choice(model, text)
        assert got == want and np.allclose(share, plain)
    assert any(len(x) > 1 for x in sets) and any(len(x) == 1 for x in sets)


def test_clashing_columns(odd):
    docs = odd.selectExpr("*", "1 as held_out", "2 as score", "3 as lang_pred", "4 as languages", "5 as c", "6 as bucket")
    assert m.identify(docs).count() == odd.count()
    assert m.relabel_documents(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
