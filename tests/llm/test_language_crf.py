import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merchlens.llm import language_crf as L
from merchlens.llm import queries
from merchlens.llm.words import text_bytes

EN = "the house of the river and that it was with this by the from are for on the stone".split()
DE = "der und die das nicht von zu mit sich auf ein eine ist im des haus stein fluss über".split()


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(w, 30)) for w in (EN, DE) for _ in range(60)]
    return L.train(texts, ["en"] * 60 + ["de"] * 60)


def test_forward_backward_against_sums():
    rng, counts = np.random.default_rng(0), np.array([3, 0, 100, 1, 33, 32, 64])
    logits, trans, start = rng.normal(0, 2, (counts.sum(), 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    got, at = L.posteriors(logits, counts, trans, start), 0
    for n in counts.tolist():
        if not n:
            continue
        x = logits[at:at + n]
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = x[0] + start
        for t in range(1, n):
            a[t] = x[t] + np.logaddexp.reduce(a[t - 1][:, None] + trans, 0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + x[t + 1] + b[t + 1], 1)
        want = np.exp(a + b - np.logaddexp.reduce(a + b, 1)[:, None])
        assert np.allclose(got[at:at + n], want)
        at += n


def test_labels_words_of_mixed_text(model):
    text = " ".join(EN[:12] + DE[:12] + EN[:9])
    post, counts = model.words(*text_bytes(pa.array([text])))
    assert counts.tolist() == [33]
    want = [1] * 12 + [0] * 12 + [1] * 9  # languages are sorted: de, en
    assert (post.argmax(1) == want).mean() > 0.9
    assert model.trans[0, 0] > model.trans[0, 1] and model.trans[1, 1] > model.trans[1, 0]


def test_gradient_lowers_loss():
    texts, langs = [" ".join(EN)] * 4 + [" ".join(DE)] * 4, ["en"] * 4 + ["de"] * 4
    for rounds, least in ((1, 0.5), (40, 0.9)):
        m = L.train(texts, langs, rounds=rounds)
        assert m.shares(*text_bytes(pa.array([" ".join(DE)])))[0, 0] > least


def test_query_on_held_out_rows(spark, sf, docs):
    rows = queries.op2_language_crf(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_usable_rows_teach(docs):
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    got = [L.fit(d, usable=queries.remainder("doc_id", 3) != 1) for d in (docs, wrong)]
    assert got[0].languages == got[1].languages and np.array_equal(got[0].weights, got[1].weights)


def test_odd_rows(odd, none, model):
    out = L.identify(odd, model)
    rows = out.collect()
    assert out.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "lang_shares"] and len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (2, 3, 5, 6) or r["text"] is None:
            assert (r["lang_pred"], r["score"]) == (L.UND, 0.0)
        else:
            assert r["lang_pred"] in ("en", "de") and abs(sum(r["lang_shares"].values()) - 1) < 1e-6
    assert L.identify(none, model).collect() == [] and L.fit(none) is None
    assert {r["lang_pred"] for r in L.identify(odd, None).collect()} == {L.UND}
    assert L.fit(odd).languages == ["de", "en", "fr"]


def test_non_ascii_letters_count_as_letters(model):
    assert model.shares(*text_bytes(pa.array(["日本 語", "… — 🙂", "éé"]))).sum(1).round(6).tolist() == [1, 0, 1]


def test_sample_is_bounded_and_reaches_every_language(spark, monkeypatch):
    """One id on 40,000 rows, one text on 40,000 rows, and junk in the language column."""
    import merchlens.llm.language_crf as L
    seen = {}

    def train(texts, labels):
        from collections import Counter
        seen.update(Counter(labels))
        seen["all"] = len(texts)

    monkeypatch.setattr(L, "train", train)
    one = spark.range(40_000).selectExpr("7L AS doc_id", "concat('eins zwei drei ', id) AS text", "'de' AS lang")
    same = spark.range(40_000).selectExpr("8L AS doc_id", "'un deux trois' AS text", "'fr' AS lang")
    many = spark.range(3000).selectExpr("id + 100 AS doc_id", "concat('one two three ', id) AS text", "'en' AS lang")
    junk = spark.range(600).selectExpr("id + 9000 AS doc_id", "'word' AS text", "concat('junk', id) AS lang")
    L.fit(one.union(same).union(many).union(junk), languages=20)
    assert seen["fr"] == 1 and seen["de"] == seen["en"] == L.TEXTS_PER_LANGUAGE and len(seen) == 21
