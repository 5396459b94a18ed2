import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from merchlens.llm import language_crf, queries, toxicity
from merchlens.llm.shared import written
from merchlens.llm.words import text_bytes
from test_jaccard_join import brute as classes
from test_toxicity import BAD, CLEAN
from test_toxicity import sample as labelled
from test_winnowing import brute as hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, docs):
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], sf), name))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "sentencepiece"]
    assert all(s.columns == COLUMNS for s in stages[:-1]) and stages[-1].columns[:5] == COLUMNS
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0


def test_models_decide_as_plain_functions(spark, sf, stages):
    import pyarrow as pa

    before, model = rows(stages[0]), language_crf.fit(stages[0])
    share = model.shares(*text_bytes(pa.array(list(before.values()), pa.string()))).max(1)
    assert set(rows(stages[1])) == {i for i, s in zip(before, share) if s >= P.LANGUAGE_SCORE}
    before, model = rows(stages[1]), toxicity.fit(stages[1], spark.read.parquet(f"{sf}/labels.parquet"))
    score = model.scores(*text_bytes(pa.array(list(before.values()), pa.string())))
    assert set(rows(stages[2])) == {i for i, s in zip(before, score) if s < P.TOXIC_SCORE}


def test_texts_in_several_languages_stay(spark, sf, docs):
    import pyarrow as pa

    def words(lang, n):
        return docs.where(F.col("lang") == lang).orderBy("doc_id").first()["text"].split()[:n]

    mixed = [words("en", 40) + words("de", 40) + ["1984", "Xq"], words("fr", 40) + words("es", 40) + ["77"], words("en", 30) + words("fr", 30) + words("de", 30),
             words("es", 25) + words("de", 25) + words("fr", 25) + words("en", 25)]
    planted = [(10**9 + i, " ".join(w), None, "planted", None) for i, w in enumerate(mixed)] + [(10**9 + 9, "12 34 !!", None, "planted", None)]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    best = language_crf.fit(both).shares(*text_bytes(pa.array([p[1] for p in planted], pa.string()))).max(1)
    assert (best[2:4] < 0.5).all()
    assert {r["doc_id"] for r in P.language_id(spark, both, sf).where("source = 'planted'").collect()} == {p[0] for p in planted[:-1]}


def test_one_of_each_group_stays(stages):
    before = rows(stages[2])
    want = {i for i, (n, c) in classes(before, P.SHINGLE, P.SIMILARITY[0]).items() if not n or c == i}
    assert set(rows(stages[3])) == want


def test_no_benchmark_passage_stays(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = rows(stages[3])
    assert set(rows(stages[4])) == {i for i, t in before.items() if not hits(t, items)[3]}


def test_tokens_decode(stages):
    assert stages[5].where("not lossless").count() == 0
    assert stages[5].where("n_tokens <> size(piece_ids)").count() == 0


def test_run_is_the_stages(spark, sf, stages):
    assert {r["doc_id"]: r["n_tokens"] for r in P.run(spark, sf).collect()} == {r["doc_id"]: r["n_tokens"] for r in stages[5].collect()}


def test_odd_rows(spark, sf, odd, none):
    """Nulls, clashing names, repeated rows: columns stay, rows only go."""
    clash = odd.withColumns({c: F.lit(1) for c in ("_lang_pred", "_toxicity", "_decoded", "text_key", "n_shingles", "component_id", "d", "o")})
    for name, stage in P.STAGES:
        out = written(stage(spark, clash, sf), name)
        assert out.columns[:len(clash.columns)] == clash.columns and out.count() <= clash.count()
        assert stage(spark, none, sf).collect() == []
    kept = written(P.near_duplicates(spark, clash, sf), "kept").collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, 2, 3, None, 4, 5, 6, 7, None, 8], key=str)


def test_groups_of_equal_rows_and_missing_ids(spark, sf):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(60))
    other = " ".join(f"v{rng.randrange(999)}" for _ in range(60))
    data = [(5, text)] * 4 + [(6, text), (None, text), (None, other), (None, other), (7, None), (7, None), (8, "")]
    made = P.near_duplicates(spark, spark.createDataFrame(data, "doc_id bigint, text string"), sf).collect()
    assert sorted(map(tuple, made), key=str) == sorted([(5, text), (None, other), (7, None), (7, None), (8, "")], key=str)


def test_misspelt_toxic_words_go_as_op7_predicts(spark, tmp_path):
    """Some labels are wrong, so that scores aren't all 0 or 1."""
    rng = random.Random(8)
    texts, labels = labelled(800, 1)
    labels = [1 - y if rng.random() < 0.04 else y for y in labels]
    spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made = []
    for i in range(600):
        words, bad = rng.choices(CLEAN, k=40), rng.choice(BAD)
        at = rng.randrange(1, len(bad) - 1)
        words.insert(rng.randrange(40), bad[:at] + rng.choice(["", bad[at] * 2, "x"]) + bad[at + 1:])
        made.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame([*enumerate(texts), *made], "doc_id bigint, text string").repartition(4)
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert any(0.3 <= score[i] < 0.5 for i, _ in made)
    assert {r["doc_id"] for r in P.toxicity_filter(spark, docs, str(tmp_path)).collect()} == {i for i, s in score.items() if s < 0.3}


def test_without_languages_all_rows_stay(spark, sf, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.language_id(spark, bare, sf).count() == docs.count()
