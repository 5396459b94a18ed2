import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from merchlens.llm import queries
from merchlens.llm import toxicity as T
from merchlens.llm.words import text_bytes

CLEAN = "the river house stone quiet morning people walk along paper garden winter music letter window bread".split()
BAD = ["scumbag", "dimwit", "blockhead"]


def sample(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(CLEAN, rng.integers(5, 120)))
        if i % 4 == 0:
            for _ in range(rng.integers(1, 4)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(BAD)))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def scores(model, texts):
    return model.scores(*text_bytes(pa.array(texts, pa.string())))


def test_learns_words_and_their_misspellings():
    model = T.train(*sample(400, 1))
    texts, labels = sample(200, 2)
    s = scores(model, texts)
    assert ((s >= 0.3) == (np.array(labels) == 1)).mean() > 0.97
    plain = " ".join(CLEAN * 3)
    hits = scores(model, [f"{plain} {w} {plain}" for w in ("scumbaggs", "dimwitt", "blockheaad", "DIMWIT")])
    assert (hits > 5 * scores(model, [plain])[0]).all() and hits[3] > 0.9
    assert scores(model, [plain])[0] < 0.3


def test_long_texts_are_not_diluted():
    model = T.train(*sample(400, 3))
    long = " ".join(CLEAN * 3000)
    a, b = scores(model, [long, f"{long} dimwit {long}"])
    assert a < 0.3 < b


def test_one_more_word_at_the_start_changes_nothing():
    model = T.train(*sample(400, 1))
    plain = " ".join(CLEAN * 3)
    for pair in ("scumbaggs dimwitt", "scumbag dimwit", "blockhead scumbagg"):
        a, b = scores(model, [f"{plain} {pair} {plain}", f"{CLEAN[0]} {plain} {pair} {plain}"])
        assert abs(a - b) < 1e-9
    assert model.window_logits(*text_bytes(pa.array(["", "bread", "the river", "the river house"])))[1].tolist() == [0, 1, 2, 3]


def test_word_grams_against_slices():
    texts = ["Ab c", "", "déf-ab"]
    buckets, owners, counts = T.word_grams(*text_bytes(pa.array(texts)))
    assert counts.tolist() == [2, 0, 2]
    per_word = np.bincount(owners, minlength=4).tolist()
    assert per_word == [sum(max(0, len(w.encode()) + 3 - n) for n in T.GRAMS) + 1 for w in ("ab", "c", "déf", "ab")]
    same = [sorted(buckets[owners == w]) for w in (0, 3)]
    assert same[0] == same[1]


def test_query_on_held_out_rows(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_toxicity(spark, sf).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    # Wrong labels of held-out rows change nothing.
    wrong = labels.withColumn("toxic", F.when(queries.remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.fit(docs, x, usable=queries.remainder("id", 4) != 2) for x in (labels, wrong))
    assert np.array_equal(a.weight, b.weight)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 0), (8, 1, 1), (8, 1, 0), (None, 1, 1), (9, None, None), (6, 1, 5)], "doc_id bigint, quality int, toxic int")
    model = T.fit(odd, labels)
    out = T.score(odd, model)
    rows = out.collect()
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"] and len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert T.score(none, model).collect() == []
    empty = T.fit(odd, labels.limit(0))
    assert {round(r["score"], 6) for r in T.score(odd, empty).collect()} == {0.0}


def test_sample_is_bounded_if_an_id_repeats(spark, monkeypatch):
    import merchlens.llm.toxicity as T
    seen = []
    monkeypatch.setattr(T, "train", lambda texts, labels: seen.extend(labels))
    docs = spark.range(30_000).selectExpr("1L AS doc_id", "concat('word ', id) AS text").union(spark.range(30_000).selectExpr("2L AS doc_id", "'same text' AS text")).union(
        spark.range(5000).selectExpr("id + 10 AS doc_id", "concat('other ', id) AS text"))
    labels = spark.range(5010).selectExpr("id AS doc_id", "CAST(id < 3 OR id % 5 = 0 AS int) AS toxic")
    T.fit(docs, labels)
    assert seen.count(1) == T.SAMPLE[1] and 0.9 * T.SAMPLE[0] <= seen.count(0) <= T.SAMPLE[0]


def test_separable_sample_has_a_bounded_scale():
    import warnings

    import merchlens.llm.toxicity as T
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        model = T.train(["good fine nice words"] * 300 + ["vile scum words"] * 300, [0] * 300 + [1] * 300)
    assert 0 < model.scale[0] < 100
