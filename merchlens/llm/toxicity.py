"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean embedding of its character n-grams (hashed, word ends
included), a window the mean of a few words in a row (every run of them is a
window, a shorter text is one as a whole); a linear softmax gives the window's two classes. A text is toxic if any window is: training
joins the windows' probabilities as 1 - prod(1 - p), with a floor for wrong
labels, and scoring takes the most toxic window, which doesn't depend on the
text's length. A word never seen shares the n-grams of words that were, and
random n-grams and windows are left out in training, so that a part of a word
or of the evidence is enough. A word's own hash counts as one more n-gram.

Training reads a bounded sample of labelled rows: at most about
``sample[label]`` texts a label, drawn by a hash of the id, and of each text
the words of at most ``windows_per_text`` windows spread over the whole text,
put next to each other. Scoring reads every window of the whole text; nothing
but the text is an input.

Defined results: null and empty texts have no window and get the score of an
empty window (the bias alone); repeated rows get equal scores; ids that have
several labels count once each; rows without a label or id teach nothing;
without any labelled row the score is 0. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from merchlens.llm.shared import small_batches
from merchlens.llm.words import ALNUM, hash_words, mix, powers, text_bytes, text_chunks, word_counts

GRAMS = (3, 4)
BUCKET_BITS = 18
DIM = 8
WINDOW = 1  # words of a window: with more, a misspelt word is averaged with its neighbours
TOXIC = 0.3  # texts that score at least this are toxic
SAMPLE = {0: 2000, 1: 1200}
WINDOWS_PER_TEXT = 1000
SCALE_L2 = 0.1
_R = np.uint64(0x9E3779B97F4A7C15)


def word_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the word each belongs to, and the words of each text."""
    texts = len(bounds) - 1
    spaced = np.full(len(data) + texts + 1, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(bounds))] = data
    word = ALNUM.is_word[spaced]
    first = word.copy()
    first[1:] &= ~word[:-1]
    number = np.cumsum(first) - 1
    codes = np.where(word, ALNUM.code[spaced], np.uint64(1))
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, bounds + np.arange(1, texts + 2)))
    # The whole word counts as one more n-gram.
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    whole = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers(len(codes))[0][:len(codes)])])
    with np.errstate(over="ignore"):
        whole = mix((whole[ends] - whole[starts]) * powers(len(codes))[1][starts])
    buckets, owners = [(whole >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], [np.arange(len(starts))]
    with np.errstate(over="ignore"):
        total, inner = codes.copy(), None
        power = np.uint64(1)
        for n in range(2, max(GRAMS) + 1):
            power = power * _R
            total = total[:len(codes) - n + 1] + codes[n - 1:] * power
            if n < 3:
                continue
            inside = word[n - 2:len(word) - 1]
            inner = inside[:len(total)] if inner is None else inner[:len(total)] & inside[:len(total)]
            if n in GRAMS:
                at = np.flatnonzero(inner)
                buckets.append((mix(total[at] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                owners.append(number[at + 1])
    return np.concatenate(buckets), np.concatenate(owners), counts


@dataclass
class Model:
    """``weight``: what each bucket adds to the difference of the two logits; ``bias``: of an empty window."""

    weight: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def window_logits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window, and the windows of each text."""
        buckets, owners, counts = word_grams(data, bounds)
        words = int(counts.sum())
        grams = np.bincount(owners, minlength=words)
        means = np.bincount(owners, self.weight[buckets], minlength=words) / np.maximum(grams, 1)
        first, size, windows = _windows(counts)
        sums = np.zeros(len(first))
        for k in range(WINDOW):
            inside = size > k
            sums[inside] += means[first[inside] + k]
        return sums / size + self.bias, windows

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        logits, windows = self.window_logits(data, bounds)
        most = np.full(len(windows), self.bias)
        some = windows > 0
        if some.any():
            most[some] = np.maximum.reduceat(logits, (np.cumsum(windows) - windows)[some])
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * most + b, -30, 30)))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and words of every window (every run of ``WINDOW`` words, or a shorter text), and the windows of each text."""
    windows = np.where(counts > WINDOW, counts - WINDOW + 1, np.minimum(counts, 1))
    return _ragged(np.cumsum(counts) - counts, windows), np.repeat(np.minimum(counts, WINDOW), windows), windows


def _grams_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of single words, one word after the other, and how many each has; a slice of words at a time."""
    grams, counts = [], []
    for at in range(0, len(starts), at_once):
        first, lengths = starts[at:at + at_once], ends[at:at + at_once] - starts[at:at + at_once]
        buckets, owner, _ = word_grams(data[_ragged(first, lengths)], np.concatenate([[0], np.cumsum(lengths)]))
        grams.append(buckets[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(first)))
    return np.concatenate(grams), np.concatenate(counts)


def train(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 48, rate: float = 0.25, noise: float = 0.03, keep: float = 0.25, keep_windows: float = 0.6, seed: int = 5) -> Model:
    """Fit embeddings and softmax together by AdaGrad on batches of texts."""
    rng = np.random.default_rng(seed)
    buckets_n = 1 << BUCKET_BITS
    if not texts or len(set(labels)) < 2:
        return Model(np.zeros(buckets_n, np.float32), 0.0, (0.0, -30.0 if not any(labels) else 30.0))
    y = np.array(labels, float)
    data, bounds = text_bytes(pa.array(texts, pa.large_string()))
    hashes, starts, ends = hash_words(data, bounds, ALNUM)
    counts = word_counts(starts, bounds)
    _, rep, kind = np.unique(hashes, return_index=True, return_inverse=True)
    kind = kind.astype(np.int32)
    grams, per_kind = _grams_of_words(data, starts[rep], ends[rep])
    del starts, ends, data, rep
    first_gram = np.cumsum(per_kind) - per_kind
    first_word = np.cumsum(counts) - counts
    E = rng.normal(0, 0.1, (buckets_n, DIM)).astype(np.float32)
    U = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([2.0, -2.0], np.float32)
    squares = [np.full_like(E, 1e-4), np.full_like(U, 1e-4), np.full_like(bias, 1e-4)]
    for _ in range(epochs):
        shuffled = rng.permutation(np.flatnonzero(counts > 0))
        for at in range(0, len(shuffled), batch):
            docs = shuffled[at:at + batch]
            n = counts[docs]
            tokens = kind[_ragged(first_word[docs], n)]
            begin, size, windows = _windows(n)
            doc_of = np.repeat(np.arange(len(docs)), windows)
            kinds, token = np.unique(tokens, return_inverse=True)
            g = grams[_ragged(first_gram[kinds], per_kind[kinds])]
            g_of = np.repeat(np.arange(len(kinds)), per_kind[kinds])
            kept = rng.random(len(g)) < keep
            g, g_of = g[kept], g_of[kept]
            share = np.maximum(np.bincount(g_of, minlength=len(kinds)), 1)
            V = np.stack([np.bincount(g_of, E[g, d], minlength=len(kinds)) / share for d in range(DIM)], 1)
            inside = token[_ragged(begin, size)]
            W = np.add.reduceat(V[inside], np.cumsum(size) - size, axis=0) / size[:, None]
            logits = W @ U + bias
            p = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -30, 30)))
            p = np.where(rng.random(len(p)) < keep_windows, p, 0)
            rest = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(docs)))
            said = noise + (1 - 2 * noise) * (1 - rest)
            down = np.where(y[docs] == 1, -1 / said, 1 / (1 - said)) * (1 - 2 * noise)
            dz = (down * rest)[doc_of] * p / len(docs) * 8
            dl = np.stack([-dz, dz], 1)
            dW = dl @ U.T / size[:, None]
            dV = np.stack([np.bincount(inside, np.repeat(dW[:, d], size), minlength=len(kinds)) / share for d in range(DIM)], 1)
            used, slot = np.unique(g, return_inverse=True)
            dE = np.stack([np.bincount(slot, dV[g_of, d], minlength=len(used)) for d in range(DIM)], 1) + 1e-6 * E[used]
            for value, square, where, grad in ((E, squares[0], used, dE), (U, squares[1], slice(None), W.T @ dl), (bias, squares[2], slice(None), dl.sum(0))):
                square[where] += grad**2
                value[where] -= rate * grad / np.sqrt(square[where])
    model = Model((E @ (U[:, 1] - U[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    # Scale of the most toxic window's logit, by a logistic fit on the sample.
    z = np.concatenate([model.scores(d, b) for _, _, d, b in text_chunks(pa.array(texts, pa.large_string()), 1 << 18)])
    z = np.log(z / (1 - z)).clip(-12, 12)
    a, b = _logistic_scale(z, y)
    model.scale = (float(max(a, 1e-3)), float(b))
    return model


def _logistic_scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by regularised logistic regression: Newton steps, halved until the loss falls, so a sample whose labels separate has a bounded scale too."""
    def loss(at: np.ndarray) -> float:
        t = at[0] * z + at[1]
        return float((np.logaddexp(0, t) - y * t).sum() + SCALE_L2 / 2 * ((at[0] - 1) ** 2 + at[1] ** 2))

    at = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-(at[0] * z + at[1]).clip(-30, 30)))
        h = q * (1 - q)
        grad = np.array([((q - y) * z).sum() + SCALE_L2 * (at[0] - 1), (q - y).sum() + SCALE_L2 * at[1]])
        step = np.linalg.solve(np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + SCALE_L2 * np.eye(2), grad)
        before = loss(at)
        while np.abs(step).max() > 1e-9 and loss(at - step) > before:
            step = step / 2
        at = at - step
        if np.abs(step).max() <= 1e-9:
            break
    return float(at[0]), float(at[1])


def _spread(limit: int):
    """Texts as at most ``limit`` windows of words spread over the whole text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(1)):
                _, starts, ends = hash_words(data, bounds, ALNUM)
                counts, at, out = word_counts(starts, bounds).tolist(), 0, []
                for n in counts:
                    windows = np.arange(0, n, WINDOW)
                    if len(windows) > limit:
                        windows = windows[np.linspace(0, len(windows) - 1, limit).astype(int)]
                    out.append(b" ".join(data[starts[at + w]:ends[at + min(w + WINDOW, n) - 1]].tobytes() for w in windows.tolist()).decode("utf-8", "replace"))
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(out, pa.string())], names=["label", "text"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None,
        sample: dict[int, int] = SAMPLE, windows_per_text: int = WINDOWS_PER_TEXT) -> Model:
    """Train on labelled rows for which ``usable`` (a column of ids) holds: of each label at most as many as ``sample`` says.

    Rows are drawn by a hash of id and text, and rows equal in both are one, so an id that holds most rows isn't drawn with all of them.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(list(sample)) & F.col("id").isNotNull()).distinct()
    if usable is not None:
        known = known.where(usable)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.col(text), F.lit(11)).alias("key"))
    counts = {r["label"]: max(r["n"], 1) for r in rows.select("id", "key").join(known, "id").groupBy("label").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not counts:
        return train([], [])
    chance = F.pmod(F.col("key"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    # Somewhat more are drawn than wanted, since the counts are estimates; of these the first by their hash stay.
    parts = {value: min(1.0, 1.5 * sample[value] / n) for value, n in counts.items()}
    of_label = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("label"))
    most = F.element_at(F.create_map(*[F.lit(x) for value in counts for x in (value, sample[value])]), F.col("label"))
    drawn = rows.where(chance < max(parts.values())).join(known, "id").where(chance < of_label).dropDuplicates(["label", "key"])
    place = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= most).select("label", "text")
    got = sorted(tuple(r) for r in chosen.mapInArrow(_spread(windows_per_text), "label int, text string").collect())
    return train([r[1] for r in got], [r[0] for r in got])


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the toxicity of each whole text in ``column`` (a column of that name is replaced)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.drop(column)
    at = kept.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(data, bounds) for _, _, data, bounds in text_chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))
