"""Training-corpus pipeline: language, toxicity, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and hands it, read again, to the next.
All stages but the last return the columns of ``docs``. Rows are told apart by
(doc_id, hash of the text); equal rows meet the same decision, and of a group
of near duplicates one row stays. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm import jaccard_join, language_crf, sentencepiece_bpe, toxicity, winnowing
from merchlens.llm.shared import documents, unused, written

LANGUAGE_SCORE = 0.5  # a text whose words are less certain of their languages (on average) is rejected, as one without a letter is
TOXIC_SCORE = toxicity.TOXIC  # as op7 predicts
SHINGLE, SIMILARITY = 5, (80, 100)  # near duplicates: words of a shingle, least Jaccard similarity


def _rows(docs: DataFrame, of: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) is in ``of(doc_id, text_key)`` ("left_semi") or isn't ("left_anti")."""
    return docs.alias("d").join(of.select("doc_id", "text_key").distinct().alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id"))
                                & (F.xxhash64("d.text") == F.col("o.text_key")), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without recognisable languages (null and empty texts among them); words may be of several. If no row has a language
    to learn from, nothing can be recognised or rejected, and all rows stay."""
    model = language_crf.fit(docs)
    if model is None:
        return docs
    made = tuple(unused(docs, c) for c in ("_lang_pred", "_lang_score", "_lang_shares"))
    sure = unused(docs, "_lang_certainty")
    marked = language_crf.identify(docs, model, columns=made, certainty=sure)
    return marked.where((F.col(made[0]) != language_crf.UND) & (F.col(sure) >= LANGUAGE_SCORE)).drop(*made, sure)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic texts; null and empty texts score as texts without words and stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "_toxicity")
    return toxicity.score(docs, model, column=name).where(F.col(name) < TOXIC_SCORE).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the least id. Null and empty texts are near nothing: all their rows stay."""
    classes = written(jaccard_join.jaccard_classes(docs, n=SHINGLE, threshold=SIMILARITY), "pipeline-classes")
    rows = classes.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id"))
    # A component's id is null only if all its ids are: then its least text hash stays.
    stays = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("s"))
    named = stays.select("s.doc_id", "s.text_key").alias("s")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_key") == F.col("s.text_key"))
    gone = rows.alias("r").join(named, same, "left_anti")
    again = rows.alias("r").join(named, same, "left_semi").where("n > 1")
    # A row that stays but is repeated is taken out whole and put back once.
    single = _rows(docs, gone.select("doc_id", "text_key").union(again.select("doc_id", "text_key")), "left_anti")
    return single.unionByName(_rows(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by benchmark items; null and empty texts hold none and stay."""
    found = winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _rows(docs, found.where("contaminated"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` with the text's ids, their number, and whether they decode to the text: a null text has null ids
    and ``n_tokens``, an empty one no ids; both are lossless."""
    name = unused(docs, "_decoded")
    made = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, column="piece_ids"), column=name)
    return made.withColumns({"n_tokens": F.size("piece_ids").cast("bigint"), "lossless": F.col(name).eqNullSafe(F.col("text"))}).drop(name)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

# Trained models decide two stages: no SQL can express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
