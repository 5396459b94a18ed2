"""Language-model scoring: an interpolated modified Kneser-Ney bigram model of sorted hash arrays.

Tokens are words (64-bit hashes, A-Z lower-cased) and one end per text; the
first token follows a begin mark.

Counting. Each task sends, per shard of contexts, its sorted distinct bigrams
with counts; Spark shuffles these blocks, and one task a shard merges them and
writes the shard: bigram hashes in order with their counts. Contexts that a
small sample shows to be very frequent are spread over all shards by the whole
bigram (this only routes; it changes no count). The shards pass on what they
saw of each word (followers, predecessors, counts), a second shuffle by word
adds it up, and word shards are written: word hashes in order with count,
number of distinct predecessors and back-off mass. Nothing is pruned, so the
model grows with the corpus. The driver holds file names and totals.

Scoring. Tasks map the files into memory and look up sorted hashes. The
probability of a token after u is
(c(u w) - D) / c(u) + back-off(u) * p(w), with p(w) from the number of distinct
predecessors, discounted likewise, and a uniform share for any token. D are
the three modified Kneser-Ney discounts of each order.

Defined results: null and empty texts are one end token; repeated rows get
equal scores; with no training text every token has the uniform probability
1. Extra columns pass through (columns named like the outputs are replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from merchlens.llm.files import arrays_from, arrays_to_bytes, map_file, write_file
from merchlens.llm.shared import new_folder, small_batches, written
from merchlens.llm.words import SPACED, hash_words, mix, text_chunks, word_counts

BEGIN, END = np.uint64(0x9D8A5C3F11E7B203), np.uint64(0x5F1D36A98C24E70B)
SHARD_TOKENS = 1_000_000
MAX_SHARDS = 16_384
FLUSH_TOKENS = 4_000_000  # bigrams a task holds before it counts and sends them
SAMPLE_TEXTS, HOT_SHARE = 2000, 0.002  # texts looked at for frequent contexts; share of tokens that makes one


def token_pairs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token of every position, and the tokens of each text."""
    hashes, starts, _ = hash_words(data, bounds, SPACED)
    counts = word_counts(starts, bounds) + 1
    tokens = np.full(int(counts.sum()), END)
    ends = np.cumsum(counts) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = hashes
    contexts = np.concatenate([[BEGIN], tokens[:-1]])
    contexts[ends[:-1] + 1] = BEGIN
    return contexts, tokens, counts


def pair_key(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(contexts) * np.uint64(0x9FB21C651E98DF25) + tokens)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash, in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _route(contexts: np.ndarray, tokens: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    out = _shard(contexts, shards)
    often = np.isin(contexts, hot)
    out[often] = _shard(pair_key(contexts[often], tokens[often]), shards)
    return out


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sort rows by keys and add up the values of equal ones."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, values
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) for v in values]


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; those of 255 and more aside, with their places."""
    large = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.uint64)]


def _large(small: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = small.astype(np.uint64)
    out[at] = values
    return out


_BLOCK = [("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.binary()), ("path", pa.string()), ("stats", pa.list_(pa.int64()))]
_SCHEMA = "kind int, shard int, block binary, path string, stats array<bigint>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_BLOCK)], names=[n for n, _ in _BLOCK])


def _count(hot: np.ndarray, shards: int):
    def blocks(contexts: np.ndarray, tokens: np.ndarray) -> Iterator[tuple]:
        shard = _route(contexts, tokens, hot, shards)
        (shard, contexts, tokens), (n,) = _summed([shard, contexts, tokens], [np.ones(len(tokens), np.uint64)])
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edges, edges[1:], strict=False):
            u = contexts[a:b]
            runs = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            made = [u[runs], np.diff(np.append(runs, b - a)).astype(np.uint32), tokens[a:b], *_small(n[a:b])]
            yield 0, int(shard[a]), b"".join(arrays_to_bytes(made)), None, None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0)):
                contexts, tokens, _ = token_pairs(data, bounds)
                held.append((contexts, tokens))
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    yield from map(_batch, ([r] for r in blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))))
                    held, size = [], 0
        if size:
            yield from map(_batch, ([r] for r in blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))))

    return run


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[np.ndarray]]]]]:
    """Blocks of one shard after the other, from rows in the order of shards."""
    now, held = None, []
    for batch in batches:
        for kind, shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append((kind, arrays_from(block.as_buffer())))
    if held:
        yield now, held


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _merge_bigrams(folder: str, shards: int, word_shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            parts = [(np.repeat(u, runs), tokens, _large(*n)) for _, (u, runs, tokens, *n) in blocks]
            (u, w), (n,) = _summed([np.concatenate([p[i] for p in parts]) for i in (0, 1)], [np.concatenate([p[2] for p in parts])])
            keys = pair_key(u, w)
            order = np.argsort(keys)
            path = write_file(f"{folder}/bigrams-{shard}", arrays_to_bytes([keys[order], *_small(n[order])]))
            yield _batch([(0, shard, None, path, [*_count_of_counts(n), len(n)])])
            one = np.ones(len(n), np.uint64)
            (words,), (before, seen) = _summed([w], [one, n])
            (contexts,), (after1, after2, after3, total) = _summed([u], [(n == 1) * one, (n == 2) * one, (n >= 3) * one, n])
            for kind, names, values in ((1, words, [before, seen]), (2, contexts, [after1, after2, after3, total])):
                place = _shard(names, word_shards)
                edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(names) else []
                for a, b in zip(edges, edges[1:], strict=False):
                    made = [names[a:b], *(x for v in values for x in _small(v[a:b]))]
                    yield _batch([(kind, int(place[a]), b"".join(arrays_to_bytes(made)), None, None)])

    return run


def _merge_words(folder: str, discounts: list[float]):
    def added(blocks: list, kind: int, columns: int):
        parts = [a for k, a in blocks if k == kind]
        keys = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        values = [np.concatenate([np.zeros(0, np.uint64), *(_large(*p[1 + 3 * c:4 + 3 * c]) for p in parts)]) for c in range(columns)]
        (keys,), values = _summed([keys], values)
        return keys, values

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            words, (before, seen) = added(blocks, 1, 2)
            contexts, (after1, after2, after3, total) = added(blocks, 2, 4)
            keys = np.union1d(words, contexts)
            columns = [np.zeros(len(keys), t) for t in (np.uint64, np.uint32, np.uint64, np.float32)]
            at, of = np.searchsorted(keys, words), np.searchsorted(keys, contexts)
            columns[0][at], columns[1][at], columns[2][of] = seen, before, total
            columns[3][of] = (discounts[0] * after1 + discounts[1] * after2 + discounts[2] * after3) / np.maximum(total, 1)
            path = write_file(f"{folder}/words-{shard}", arrays_to_bytes([keys, *columns]))
            yield _batch([(3, shard, None, path, [*_count_of_counts(before), int(before.sum()), len(words), int(seen.sum())])])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 or more, kept between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), c) for d, c in zip(out, (0.95, 1.95, 2.95), strict=True)]


@lru_cache(maxsize=100_000)
def _open(path: str) -> list[np.ndarray]:
    return arrays_from(map_file(path))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted ``wanted`` in sorted ``keys``, and which are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    tokens: int = 0  # N: training tokens
    kinds: int = 0  # V: distinct training tokens
    pairs: int = 0  # distinct bigrams
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    high: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    low: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    rest: float = 1.0  # share of the uniform distribution in p(w)
    bigrams: list[str | None] = field(default_factory=list)
    words: list[str | None] = field(default_factory=list)

    def _words(self, wanted: np.ndarray) -> list[np.ndarray]:
        """Count, distinct predecessors, total as context and back-off mass of sorted distinct hashes."""
        out = [np.zeros(len(wanted), t) for t in (np.uint64, np.uint32, np.uint64, np.float32)]
        out[3][:] = 1
        self._each(self.words, wanted, _shard(wanted, len(self.words)), lambda arrays, at, hit: [
            o.__setitem__(at[hit], a[_find(arrays[0], wanted[at])[0][hit]]) for o, a in zip(out, arrays[1:], strict=True)])
        out[3][out[2] == 0] = 1
        return out

    @staticmethod
    def _each(paths: list, keys: np.ndarray, shard: np.ndarray, use) -> None:
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if (path := paths[int(shard[a])]) is not None:
                arrays = _open(path)
                at = np.arange(a, b)
                use(arrays, at, _find(arrays[0], keys[a:b])[1])

    def _pairs(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys, shard = pair_key(contexts, tokens), _route(contexts, tokens, self.hot, len(self.bigrams))
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        found = np.zeros(len(keys), np.uint64)

        def use(arrays, at, hit):
            place = _find(arrays[0], keys[at])[0][hit]
            n = arrays[1][place].astype(np.uint64)
            if len(arrays[2]):
                big = np.flatnonzero(n == 255)
                n[big] = arrays[3][np.searchsorted(arrays[2], place[big])]
            found[at[hit]] = n

        self._each(self.bigrams, keys, shard, use)
        out = np.empty_like(found)
        out[order] = found
        return out

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score and model score (log10)."""
        contexts, tokens, counts = token_pairs(data, bounds)
        first = np.cumsum(counts) - counts
        if not self.tokens:
            zero = np.zeros(len(counts))
            # c = N = V = 0: each token has the base (0 + 0.5) / (0 + 0.5) = 1.
            return counts, np.zeros(len(counts), np.int64), zero, zero
        kinds, of = np.unique(np.concatenate([contexts, tokens]), return_inverse=True)
        u, w = of[:len(tokens)], of[len(tokens):]
        seen, before, total, mass = self._words(kinds)
        base = np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))[w]
        cut = np.array([0.0, *self.low])[np.minimum(before, 3)]
        low = (before - cut) / max(self.pairs, 1) + self.rest / (self.kinds + 1)
        n = self._pairs(contexts, tokens)
        cut = np.array([0.0, *self.high])[np.minimum(n, 3).astype(np.int64)]
        p = (n - cut) / np.maximum(total[u], 1) + mass[u].astype(float) * low[w]
        return (counts, np.add.reduceat((seen > 0)[w].astype(np.int64), first),
                np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first))


def fit(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count and write the model of all rows of ``docs``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    rows = texts.count()
    if not rows:
        return Model()

    def glance(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0)):
                contexts, _, counts = token_pairs(data, bounds)
                keys, n = np.unique(contexts, return_counts=True)
                often = n >= max(2, HOT_SHARE * len(contexts))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often], 0).astype(np.uint64).view(np.int64)), pa.array(np.append(n[often], counts.sum()))], names=["word", "n"])

    # Only routes and sizes: the counts below cover every row.
    chance = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)).cast("double") / float(1 << 30)
    looked = texts.where(chance < SAMPLE_TEXTS / rows).mapInArrow(glance, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in looked.orderBy(F.desc("n")).limit(1 + int(1 / HOT_SHARE)).collect()}
    sampled = got.pop(0, 0)
    hot = np.sort(np.array([w for w, n in got.items() if n >= HOT_SHARE * sampled], np.int64).view(np.uint64))
    tokens = max(sampled, 1) * max(1.0, rows / SAMPLE_TEXTS)
    shards = int(min(MAX_SHARDS, max(4, tokens // shard_tokens)))
    word_shards = max(1, shards // 4)
    folder = new_folder(spark, "kneser-ney")

    def together(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(n, "shard").sortWithinPartitions("shard")

    blocks = together(texts.mapInArrow(_count(hot, shards), _SCHEMA), shards)
    merged = written(blocks.mapInArrow(_merge_bigrams(folder, shards, word_shards), _SCHEMA), "kneser-ney-words")
    files = merged.where("kind = 0").select("shard", "path", "stats").collect()  # one row a shard
    sums = [sum(r["stats"][i] for r in files) for i in range(5)]
    high = discounts(*sums[:4])
    counted = together(merged.where("kind > 0"), word_shards).mapInArrow(_merge_words(folder, high), _SCHEMA)
    lists = counted.select("shard", "path", "stats").collect()
    total = [sum(r["stats"][i] for r in lists) for i in range(7)]
    low = discounts(*total[:4])
    ones, twos = total[0], total[1]
    rest = (low[0] * ones + low[1] * twos + low[2] * (total[5] - ones - twos)) / max(sums[4], 1)
    paths = [[None] * n for n in (shards, word_shards)]
    for into, found in zip(paths, (files, lists), strict=True):
        for r in found:
            into[r["shard"]] = r["path"]
    return Model(total[6], total[5], sums[4], hot, high, low, rest, paths[0], paths[1])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 probability) and ``perplexity`` of each whole text."""
    small_batches(df.sparkSession)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kept = df.drop(*names)
    at = kept.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(data, bounds) for _, _, data, bounds in text_chunks(batch.column(at))]
            if not parts:
                continue
            n, known, base, got = (np.concatenate(p) for p in zip(*parts, strict=True))
            made = [n.astype(np.int64), known, np.full(len(n), shared.value.tokens, np.int64), base, got, 10 ** np.minimum(-got / n, 300)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, *names])

    kinds = [LongType()] * 3 + [DoubleType()] * 3
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))]))
