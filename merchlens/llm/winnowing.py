"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hash of every run of
``window - k + 1`` neighbouring k-grams. Equal runs of ``window`` words give
equal k-grams, so every shared span of ``window`` words or more has a
fingerprint on both sides: joining fingerprints misses no such span. Each
joined fingerprint is extended to the windows around it (compared by the hash
of all their words), which gives the exact hits. Items of fewer words than a
window are one window and one fingerprint of their own length.

Documents are read once, in a pass that keeps a document's fingerprints only
if the benchmark has them, as long as the benchmark's distinct fingerprints
are at most ``broadcast_limit`` (counted first). A larger benchmark is not
broadcast: all fingerprints go into the join, with the same result.

Defined results: a null or empty text has no words and is clean; a null or
empty item occurs nowhere; a repeated item counts once by its id, a null item
id isn't listed; repeated documents are judged alike; input columns other than
id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.shared import small_batches, written
from merchlens.llm.words import ALNUM, hash_words, rolling, text_chunks, word_counts

WINDOW = 13
K = 5
BROADCAST_LIMIT = 1_000_000  # fingerprints, 8 bytes each

_FINGERPRINTS = "array<struct<fp:bigint,at:int,words:int,wins:array<bigint>>>"
_ARROW = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("wins", pa.list_(pa.int64()))]))
_TOP = np.uint64(2**64 - 1)


class Filter:
    """Which hashes the benchmark has: a bit table by the low bits, then a search in the sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = max(12, int(len(self.sorted)).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.sorted & self.mask] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of ``hashes`` that the benchmark has."""
        at = np.flatnonzero(self.seen[hashes & self.mask])
        if not len(at):
            return at
        found = np.searchsorted(self.sorted, hashes[at])
        found[found == len(self.sorted)] = 0
        return at[self.sorted[found] == hashes[at]]


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """Least or greatest of every n neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:len(x) - step], x[step:])
        have += step
    return x


def winnow(hashes: np.ndarray, text_of: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes, positions of the fingerprints among them, and the hash of every window (top value: crosses texts)."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, windows = rolling(hashes, k), rolling(hashes, window)
    whole = text_of[:len(windows)] == text_of[window - 1:]
    windows[~whole] = _TOP
    least = _slide(grams, window - k + 1, np.minimum)
    least[~whole] = 0
    edge = np.zeros(window - k, np.uint64)
    chosen = _slide(np.concatenate([edge, least, edge]), window - k + 1, np.maximum)
    return grams, np.flatnonzero((grams == chosen) & (chosen > 0)), windows


def _pass(window: int, k: int, lengths: list[int], keep, whole_items: bool):
    """The pass over texts: rows of (id, text key, words, fingerprints)."""

    def one_chunk(data: np.ndarray, bounds: np.ndarray):
        wanted = keep.value if keep is not None else None
        hashes, starts, _ = hash_words(data, bounds, ALNUM)
        counts = word_counts(starts, bounds)
        first = np.concatenate([[0], np.cumsum(counts)])
        text_of = np.repeat(np.arange(len(counts)), counts)
        grams, at, windows = winnow(hashes, text_of, window, k)
        if wanted is not None and len(at):
            at = at[wanted(grams[at])]
        # Extension: the windows that hold the k-gram, as far as its text goes.
        around = at[:, None] + np.arange(k - window, 1)
        inside = (around >= 0) & (around < len(windows))
        inside[inside] = windows[around[inside]] != _TOP
        found = [(grams[at], np.where(inside, around, len(hashes)).min(1, initial=len(hashes)), np.full(len(at), window), inside.sum(1), windows[around[inside]])]
        for n in lengths:
            spans = rolling(hashes, n)
            p = wanted(spans) if wanted is not None else np.arange(len(spans))
            p = p[text_of[p] == text_of[p + n - 1]]
            if whole_items:
                p = p[counts[text_of[p]] == n]
            found.append((spans[p], p, np.full(len(p), n), np.ones(len(p), np.int64), spans[p]))
        fp, begin, words, n_wins = (np.concatenate([f[i] for f in found]) for i in range(4))
        wins = np.concatenate([f[4] for f in found])
        text = text_of[begin] if len(begin) else begin
        order = np.argsort(text, kind="stable")
        ends = np.concatenate([[0], np.cumsum(n_wins)])
        take = np.repeat(ends[:-1][order] - np.concatenate([[0], np.cumsum(n_wins[order])])[:-1], n_wins[order]) + np.arange(len(wins))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_wins[order])]).astype(np.int32)), pa.array(wins[take].view(np.int64)))
        rows = pa.StructArray.from_arrays([
            pa.array(fp[order].view(np.int64)), pa.array((begin - first[text])[order].astype(np.int32)), pa.array(words[order].astype(np.int32)), lists],
            fields=list(_ARROW.value_type))
        per_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))]).astype(np.int32)
        return counts, pa.ListArray.from_arrays(pa.array(per_text), rows).cast(_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(2)):
                counts, found = one_chunk(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(counts.astype(np.int64)), found],
                                                 names=["id", "text_key", "n_words", "fps"])

    return run


def _fingerprinted(df: DataFrame, id: str, text: str, window: int, k: int, lengths: list[int], keep=None, whole_items: bool = False) -> DataFrame:
    rows = df.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_pass(window, k, lengths, keep, whole_items), f"id {kind}, text_key bigint, n_words bigint, fps {_FINGERPRINTS}")


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, k: int = K, share: int = 20, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Per document: id, ``text_key`` (hash of the text), ``n_words``, ``n_hit``, ``item_ids`` (sorted strings), ``contaminated`` (share * n_hit >= n_words)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = written(_fingerprinted(items, item, item_text, window, k, list(range(1, window)), whole_items=True), "winnow-items")
    spans = known.select(F.col("id").alias("item"), F.explode("fps").alias("f")).groupBy("f.fp", "item").agg(
        F.array_distinct(F.flatten(F.collect_set("f.wins"))).alias("item_wins"))
    lengths = sorted(r[0] for r in known.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect())  # fewer than a window
    fps = known.select(F.explode("fps.fp").alias("fp")).distinct()
    keep = None
    if fps.count() <= broadcast_limit:
        keep = spark.sparkContext.broadcast(Filter(np.array([r[0] for r in fps.collect()], np.int64).view(np.uint64)))
    numbered = F.monotonically_increasing_id()
    marked = written(_fingerprinted(docs, id, text, window, k, lengths, keep).withColumn("row", numbered), "winnow-docs")
    met = marked.select("row", F.explode("fps").alias("f")).join(spans.withColumnRenamed("fp", "item_fp"), F.col("f.fp") == F.col("item_fp"))
    hits = met.select("row", "item", F.filter(
        F.transform("f.wins", lambda w, i: F.when(F.array_contains("item_wins", w), F.struct((F.col("f.at") + i).alias("s"), F.col("f.words").alias("n")))),
        lambda x: x.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    merged = F.aggregate(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))),
                         F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                         lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["s"] + h["n"] - F.greatest(a["end"], h["s"]))).alias("n"),
                                               F.greatest(a["end"], h["s"] + h["n"]).alias("end")))["n"]
    found = hits.groupBy("row").agg(merged.cast("bigint").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    out = marked.drop("fps").join(found, "row", "left").drop("row")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(F.col("id").alias(id), "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
