"""Language ID: a linear-chain conditional random field over the words of code-switched text.

Features of a word: its prefixes and suffixes, its character 2- and 3-grams
(hashed) and what a lexicon learnt from the sample says about it (the
language it favours, in steps of how clearly). Transitions between languages
are learnt with them, on sequences that splice stretches of texts of
different languages. Forward-backward gives every word's distribution; a
text's language is the one with the largest mean over its words.

Forward-backward runs over whole texts of any length in blocks: transfer
matrices of all blocks at once, a scan over each text's blocks, then the words
inside all blocks at once.

Training reads a bounded sample: at most about ``texts_per_language`` texts of
each language, drawn by a hash of the id, and of each ``STRETCHES`` stretches
of words spread over the whole text. Only the text is an input of a
prediction.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any usable row every text is ``und``; ties go to the language that
sorts first; repeated rows get equal results. Extra columns pass through
(columns named like the outputs are replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from merchlens.llm.shared import small_batches
from merchlens.llm.words import ALNUM, hash_words, mix, powers, text_bytes, text_chunks, word_counts

BUCKET_BITS = 16
PREFIXES, SUFFIXES, GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)
TEXTS_PER_LANGUAGE, LANGUAGES = 400, 256
STRETCHES, STRETCH = 6, 16
CONFIDENCE = (0.5, 0.8, 0.95)  # steps of the lexicon's features
BLOCK = 32
UND = "und"


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affix and n-gram features of words: buckets, and the word each belongs to (sorted)."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    flat = ALNUM.code[data[np.arange(lengths.sum()) + np.repeat(starts - first, lengths)]]
    up, down = powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * up[:len(flat)], out=sums[1:])

        def span(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
            return (mix((sums[b] - sums[a]) * down[a] + np.uint64(salt)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

        words, last = np.arange(len(starts)), first + lengths
        found = [(span(first, np.minimum(first + k, last), k), words) for k in PREFIXES]
        found += [(span(np.maximum(last - k, first), last, 16 + k), words) for k in SUFFIXES]
        owner = np.repeat(words, lengths)
        for n in GRAMS:
            at = np.flatnonzero(owner[:max(0, len(owner) - n + 1)] == owner[n - 1:])
            found.append((span(at, at + n, 32 + n), owner[at]))
    bucket, of = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(of, kind="stable")
    return bucket[order], of[order]


def _per_word(weights: np.ndarray, bucket: np.ndarray, of: np.ndarray, words: int) -> np.ndarray:
    return np.stack([np.bincount(of, weights[bucket, y], minlength=words) for y in range(weights.shape[1])], 1).astype(float)


def _scan(M: np.ndarray, place: np.ndarray, backward: bool) -> np.ndarray:
    """Products of each text's matrices up to (or from) each of its blocks; ``place``: blocks of the text before (after) it."""
    M, step = M.copy(), 1
    while (at := np.flatnonzero(place >= step)).size:
        new = M[at] @ M[at + step] if backward else M[at - step] @ M[at]
        M[at] = new / new.max((1, 2), keepdims=True)
        step *= 2
    return M


def posteriors(logits: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward: the distribution of every word of texts with ``counts`` words."""
    words, S = logits.shape
    if not words:
        return logits
    e = np.exp(logits - logits.max(1, keepdims=True)) + 1e-30
    A, pi = np.exp(trans), np.exp(start)
    blocks = -(-counts // BLOCK)
    first_block, total = np.cumsum(blocks) - blocks, int(blocks.sum())
    place = np.arange(words) - np.repeat(np.cumsum(counts) - counts, counts)
    block = np.repeat(first_block, counts) + place // BLOCK
    X, real = np.ones((total, BLOCK, S)), np.zeros((total, BLOCK, 1), bool)
    X[block, place % BLOCK], real[block, place % BLOCK] = e, True
    before = np.arange(total) - np.repeat(first_block, blocks)
    after = np.repeat(blocks, blocks) - 1 - before
    opening = (before == 0)[:, None]
    M = np.broadcast_to(np.eye(S), (total, S, S)).copy()
    for t in range(BLOCK):
        new = (M.reshape(-1, S) @ A).reshape(total, S, S) * X[:, t, None]
        if t == 0:
            new = np.where(opening[..., None], pi * X[:, 0, None], new)
        M = np.where(real[:, t, None], new / new.max((1, 2), keepdims=True), M)
    ahead = np.ones((total, S))
    later = np.flatnonzero(before > 0)
    ahead[later] = _scan(M, before, False)[later - 1, 0]
    behind = np.ones((total, S))
    earlier = np.flatnonzero(after > 0)
    behind[earlier] = _scan(M, after, True)[earlier + 1].sum(2)
    alphas, a = np.empty_like(X), ahead
    for t in range(BLOCK):
        new = (a @ A) * X[:, t]
        if t == 0:
            new = np.where(opening, pi * X[:, 0], new)
        a = np.where(real[:, t], new / new.sum(1, keepdims=True), a)
        alphas[:, t] = a
    b = behind
    for t in range(BLOCK - 1, -1, -1):
        alphas[:, t] *= b
        new = (X[:, t] * b) @ A.T
        b = np.where(real[:, t], new / new.sum(1, keepdims=True), b)
    out = alphas[block, place % BLOCK]
    return out / out.sum(1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket and lexicon feature by language
    trans: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    entry: np.ndarray  # lexicon feature of each

    def word_logits(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, rep, kind = np.unique(hashes, return_index=True, return_inverse=True)
        bucket, of = features(data, starts[rep], ends[rep])
        out = _per_word(self.weights, bucket, of, len(rep))
        if len(self.lexicon):
            at = np.searchsorted(self.lexicon, hashes[rep])
            at[at == len(self.lexicon)] = 0
            known = self.lexicon[at] == hashes[rep]
            out[known] += self.weights[self.entry[at[known]]]
        return out[kind]

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's distribution over the languages, and the words of each text."""
        hashes, starts, ends = hash_words(data, bounds, ALNUM)
        counts = word_counts(starts, bounds)
        return posteriors(self.word_logits(hashes, data, starts, ends), counts, self.trans, self.start), counts

    def shares(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean distribution of each text's words; zeros for texts without a letter."""
        return self.shares_and_certainty(data, bounds)[0]

    def shares_and_certainty(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``shares``, and the mean over each text's words of the word's most probable language's probability."""
        post, counts = self.words(data, bounds)
        text = np.repeat(np.arange(len(counts)), counts)
        out = np.stack([np.bincount(text, post[:, y], minlength=len(counts)) for y in range(len(self.languages))], 1) / np.maximum(counts, 1)[:, None]
        sure = np.bincount(text, post.max(1), minlength=len(counts)) / np.maximum(counts, 1)
        letter = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data | 32) - np.uint8(97) < 26, out=letter[1:])
        for i in np.flatnonzero(letter[bounds[1:]] == letter[bounds[:-1]]):
            if not any(map(str.isalpha, data[bounds[i]:bounds[i + 1]].tobytes().decode("utf-8", "replace"))):
                out[i], sure[i] = 0, 0
        return out, sure


def train(texts: list[str], langs: list[str], sequence: int = 64, rounds: int = 60, rate: float = 0.5, l2: float = 1e-5, seed: int = 3) -> Model | None:
    """Fit features and transitions on spliced sequences; ``texts`` are stretches of words, each of one language."""
    languages = sorted(set(langs))
    data, bounds = text_bytes(pa.array(texts, pa.large_string()))
    hashes, starts, ends = hash_words(data, bounds, ALNUM)
    counts = word_counts(starts, bounds)
    if not len(hashes):
        return None
    S, rng = len(languages), np.random.default_rng(seed)
    label = np.repeat(np.array([languages.index(x) for x in langs]), counts)
    uniq, rep, kind = np.unique(hashes, return_index=True, return_inverse=True)
    bucket, of = features(data, starts[rep], ends[rep])
    # Lexicon: words met at least three times, by the share of the language they favour.
    seen = np.zeros((len(uniq), S))
    np.add.at(seen, (kind, label), 1)
    often = seen.sum(1)
    in_lexicon = np.flatnonzero(often >= 3)
    best, share = seen[in_lexicon].argmax(1), seen[in_lexicon].max(1) / often[in_lexicon]
    entry = (1 << BUCKET_BITS) + best * (len(CONFIDENCE) + 1) + np.searchsorted(CONFIDENCE, share)
    bucket, of = np.concatenate([bucket, entry]), np.concatenate([of, in_lexicon])
    # Sequences: parts of the stretches, in random order, cut to equal lengths.
    first, parts = np.cumsum(counts) - counts, []
    for i in rng.permutation(np.flatnonzero(counts > 0)):
        at, cut = 0, int(rng.integers(3, 24))
        while at < counts[i]:
            parts.append(np.arange(first[i] + at, first[i] + min(at + cut, counts[i])))
            at += cut
    order = np.concatenate([parts[i] for i in rng.permutation(len(parts))])
    pad = -len(order) % sequence
    real = np.concatenate([np.ones(len(order), bool), np.zeros(pad, bool)]).reshape(-1, sequence)
    order = np.concatenate([order, np.zeros(pad, np.int64)]).reshape(-1, sequence)
    Y, K, N = label[order], kind[order], len(order)
    weights = np.zeros(((1 << BUCKET_BITS) + S * (len(CONFIDENCE) + 1), S))
    trans, start = np.zeros((S, S)), np.zeros(S)
    squares = [np.full_like(v, 1e-8) for v in (weights, trans, start)]
    gold = np.eye(S)[Y] * real[..., None]
    pairs = real[:, 1:] & real[:, :-1]
    gold_pairs = np.zeros((S, S))
    np.add.at(gold_pairs, (Y[:, :-1][pairs], Y[:, 1:][pairs]), 1)
    for _ in range(rounds):
        logits = _per_word(weights, bucket, of, len(uniq))[K]
        e, A = np.exp(logits - logits.max(2, keepdims=True)) + 1e-30, np.exp(trans)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        a = e[:, 0] * np.exp(start)
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, sequence):
            a = (alpha[:, t - 1] @ A) * e[:, t]
            alpha[:, t] = np.where(real[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        expected = np.zeros((S, S))
        for t in range(sequence - 2, -1, -1):
            b = e[:, t + 1] * beta[:, t + 1]
            xi = alpha[:, t, :, None] * A * b[:, None]
            xi /= xi.sum((1, 2), keepdims=True)
            expected += xi[pairs[:, t]].sum(0)
            b = b @ A.T
            beta[:, t] = np.where(real[:, t + 1, None], b / b.sum(1, keepdims=True), 1)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        residual = (post * real[..., None] - gold).reshape(-1, S) / N
        per_kind = np.stack([np.bincount(K.ravel(), residual[:, y], minlength=len(uniq)) for y in range(S)], 1)
        grads = (np.stack([np.bincount(bucket, per_kind[of, y], minlength=len(weights)) for y in range(S)], 1) + l2 * weights,
                 (expected - gold_pairs) / N + l2 * trans, (post[:, 0] - gold[:, 0]).sum(0) / N + l2 * start)
        for value, square, grad in zip((weights, trans, start), squares, grads, strict=True):
            square += grad**2
            value -= rate * grad / np.sqrt(square)
    return Model(languages, weights, trans, start, uniq[in_lexicon], entry)


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column(1)):
            _, starts, ends = hash_words(data, bounds, ALNUM)
            at, rows = 0, []
            for lang, n in zip(batch.column(0)[lo:hi].to_pylist(), word_counts(starts, bounds).tolist(), strict=True):
                for w in np.unique(np.linspace(0, max(0, n - STRETCH), STRETCHES).astype(int)).tolist() if n else []:
                    rows.append((lang, data[starts[at + w]:ends[at + min(w + STRETCH, n) - 1]].tobytes().decode("utf-8", "replace")))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["lang", "text"])


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None,
        texts_per_language: int = TEXTS_PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """Learn from at most ``texts_per_language`` rows of each language for which ``usable`` holds; of more than ``languages`` languages the commonest.

    Rows are drawn by a hash of id and text, and rows equal in both are one, so neither an id nor a text that holds most rows is drawn with all of them, or leaves none to draw.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if usable is not None:
        known = known.where(usable)
    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.col(text), F.lit(13)).alias("key"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages).collect()
    if not found:
        return None
    chance = F.pmod(F.col("key"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    # Somewhat more are drawn than wanted, since the counts are estimates; of these the first by their hash stay.
    part = F.try_element_at(F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, 1.5 * texts_per_language / max(r["n"], 1)))]), F.col("lang"))
    drawn = rows.where(chance < part).dropDuplicates(["lang", "key"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= texts_per_language).select("lang", "text")
    got = sorted((r["lang"], r["text"]) for r in chosen.mapInArrow(_stretches, "lang string, text string").collect())
    return train([r[1] for r in got], [r[0] for r in got])


def identify(df: DataFrame, model: Model | None, text: str = "text", columns: tuple[str, str, str] = ("lang_pred", "score", "lang_shares"), certainty: str | None = None) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (the mean probability of that language) and ``lang_shares`` (of all languages), or as ``columns`` names them; ``certainty``: a column for the mean over the words of their largest probability."""
    small_batches(df.sparkSession)
    extra = [certainty] if certainty else []
    kept = df.drop(*columns, *extra)
    kind = MapType(StringType(), DoubleType())
    if model is None:
        return kept.withColumns(dict(zip(columns, (F.lit(UND), F.lit(0.0), F.lit(None).cast(kind)), strict=True)) | {c: F.lit(0.0) for c in extra})
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.languages
        S = len(names)
        for batch in batches:
            found = [shared.value.shares_and_certainty(data, bounds) for _, _, data, bounds in text_chunks(batch.column(at))]
            shares = np.concatenate([np.zeros((0, S)), *[x for x, _ in found]])
            sure = [pa.array(np.minimum(np.concatenate([np.zeros(0), *[x for _, x in found]]), 1))] if extra else []
            best = shares.argmax(1)
            score = np.minimum(shares.max(1), 1)
            pred = np.where(score > 0, np.array(names, object)[best], UND)
            maps = pa.MapArray.from_arrays(pa.array(np.arange(len(shares) + 1) * S, pa.int32()), pa.array(names * len(shares), pa.string()), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), maps, *sure], names=[*batch.schema.names, *columns, *extra])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *(StructField(n, k) for n, k in zip(columns, (StringType(), DoubleType(), kind), strict=True)), *(StructField(c, DoubleType()) for c in extra)]))
