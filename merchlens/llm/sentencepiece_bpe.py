"""SentencePiece encoding and decoding, with seeded merge-dropout.

Encoding keeps an agenda of candidate merges of each word (a run of spaces and
what follows it; the vocabulary's pieces hold a space only at their start, so
no merge crosses words): the best piece is taken first, the leftmost of equal
ones, and a candidate is skipped for good if a hash keyed by (draw, place, both
pieces) falls under ``dropout``. The draw is a 64-bit hash of (seed, row key,
occurrence), so every occurrence of a word flips coins of its own, and a rerun
flips the same. Work is shared only where that changes nothing: occurrences of
a word that skip none of the candidates of its plain encoding, or that decide
all candidates of another occurrence's encoding as it does. Dropout 0 gives the
library's own encoding.

Words are encoded together in numpy, a step of all agendas at a time; very
long words use a heap each. Decoding joins the pieces' bytes: characters
without a piece, and the space mark itself, are written as byte pieces, so
every text comes back unchanged.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids; repeated rows with equal keys get equal ids. Extra columns pass
through (a column named like the output is replaced). The model file is read
on the driver only, and its tables (bounded by the vocabulary) are broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from merchlens.llm.shared import small_batches, unused
from merchlens.llm.words import mix, powers, text_chunks

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
MARK = "▁"
LONG_WORD = 64  # characters; longer words use a heap each
BLOCK_CELLS = 1 << 18  # symbols of the words merged together
SHARED_FROM = 3  # occurrences in a chunk from which a word is also encoded without dropout, to share that
ENCODE_BYTES, DECODE_IDS = 1 << 20, 200_000  # of the texts encoded or decoded in one numpy pass
_NONE = np.int32(2**31 - 1)
_CODES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass
class Vocabulary:
    of_char: np.ndarray  # id by code point, or -1
    keys: np.ndarray  # open-addressed table of pairs: left * 2**20 + right, -1: free
    merged: np.ndarray  # id of the pair's piece
    probes: int
    rank: np.ndarray  # place of a piece in the order of merging
    byte_id: np.ndarray
    piece_bytes: np.ndarray  # bytes of all pieces, one after the other
    piece_ends: np.ndarray

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.int64) << 20 | right[todo]
        at = _slot(key, len(self.keys))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key
            out[todo[hit]] = self.merged[at[hit]]
            go = ~hit & (held != -1)
            if not go.any():
                break
            todo, key, at = todo[go], key[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def load(path: str = PIECE_MODEL) -> Vocabulary:
    """Tables of a SentencePiece BPE model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    of_char = np.full(0x110000, -1, np.int32)
    for piece, i in plain.items():
        if len(piece) == 1:
            of_char[ord(" ") if piece == MARK else ord(piece)] = i
    pairs = {(plain[p[:k]] << 20 | plain[p[k:]]): i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
    size = 1 << (4 * len(pairs)).bit_length()
    keys, merged, probes = np.full(size, -1, np.int64), np.zeros(size, np.int32), 1
    slots = _slot(np.array(list(pairs), np.int64), size).tolist()
    for (key, i), at in zip(pairs.items(), slots, strict=True):
        steps = 1
        while keys[at] != -1:
            at, steps = (at + 1) & (size - 1), steps + 1
        keys[at], merged[at], probes = key, i, max(probes, steps)
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    byte_id, raw = np.zeros(256, np.int32), []
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_id[value] = i
            raw.append(bytes([value]))
        else:
            raw.append(model.id_to_piece(i).replace(MARK, " ").encode() if model.id_to_piece(i) in plain else b"")
    return Vocabulary(of_char, keys, merged, probes, rank, byte_id, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def _candidate(left, right, place) -> np.ndarray:
    """Hash of a candidate within its word."""
    with np.errstate(over="ignore"):
        return mix((np.asarray(left).astype(np.uint64) << np.uint64(40)) ^ (np.asarray(right).astype(np.uint64) << np.uint64(20)) ^ np.asarray(place).astype(np.uint64))


def _skipped(candidate: np.ndarray, draw: np.ndarray, dropout: float, seed: int) -> np.ndarray:
    if not dropout:
        return np.zeros(len(candidate), bool)
    with np.errstate(over="ignore"):
        key = mix(candidate + np.asarray(draw).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (key >> np.uint64(11)).astype(np.float64) < dropout * 2**53


def merge_word(vocab: Vocabulary, symbols: list[int], draw: int, dropout: float, seed: int) -> list[int]:
    """One word's agenda as a heap of (rank, place): symbols left after all merges (negative: characters without a piece)."""
    ids, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def push(places: list[int]) -> None:
        left = [p for p in places if p >= 0 and after[p] < len(ids)]
        a, b = np.array([ids[p] for p in left], np.int64), np.array([ids[after[p]] for p in left], np.int64)
        made = vocab.pair(a, b)
        made[_skipped(_candidate(np.maximum(a, 0), np.maximum(b, 0), np.array(left, np.int64)), np.full(len(left), draw, np.uint64), dropout, seed)] = -1
        for p, m in zip(left, made.tolist(), strict=True):
            if m >= 0:
                heapq.heappush(agenda, (int(vocab.rank[m]), p, m, ids[p], ids[after[p]]))

    push(list(range(len(ids))))
    gone = [False] * len(ids)
    while agenda:
        _, p, m, left, right = heapq.heappop(agenda)
        q = after[p]
        if gone[p] or q >= len(ids) or ids[p] != left or ids[q] != right:
            continue
        ids[p], gone[q], after[p] = m, True, after[q]
        if after[q] < len(ids):
            before[after[q]] = p
        push([before[p], p])
    return [ids[p] for p in range(len(ids)) if not gone[p]]


def merge_words(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray, draws: np.ndarray, dropout: float, seed: int,
                met: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All agendas of words at once: symbols left, and how many each word has; ``met`` gets the word and the hash of every candidate (of words up to ``LONG_WORD``)."""
    first = np.cumsum(lengths) - lengths
    left = np.ones(len(symbols), bool)
    out = symbols.copy()
    edges = [1, 4, 8, 12, 16, 24, 40, LONG_WORD]
    for low, high in zip(edges, edges[1:], strict=False):
        words = np.flatnonzero((lengths > low) & (lengths <= high))
        rows = BLOCK_CELLS // high
        for at in range(0, len(words), rows):
            part = words[at:at + rows]
            cells = first[part][:, None] + np.arange(high)
            inside = np.arange(high) < lengths[part][:, None]
            ids = np.where(inside, symbols[np.minimum(cells, len(symbols) - 1)], -1)
            kept = _merge_block(vocab, ids, lengths[part], draws[part], dropout, seed, part, met)
            out[cells[inside]], left[cells[inside]] = ids[inside], kept[inside]
    for w in np.flatnonzero(lengths > LONG_WORD).tolist():
        span = slice(first[w], first[w] + lengths[w])
        made = merge_word(vocab, symbols[span].tolist(), int(draws[w]), dropout, seed)
        out[first[w]:first[w] + len(made)] = made
        left[first[w] + len(made):first[w] + lengths[w]] = False
    return out[left], np.add.reduceat(left, first).astype(np.int64) if len(lengths) else lengths


def _merge_block(vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray, draws: np.ndarray, dropout: float, seed: int,
                 words: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]] | None) -> np.ndarray:
    """Merge the rows of ``ids`` in place; which cells are left."""
    n, width = ids.shape
    after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
    made = np.full((n, width), -1, np.int32)
    rank = np.full((n, width), _NONE, np.int32)
    kept = np.ones((n, width), bool)

    def consider(rows: np.ndarray, cells: np.ndarray) -> None:
        then = after[rows, cells]
        ok = then < lengths[rows]
        rank[rows[~ok], cells[~ok]] = _NONE
        rows, cells, then = rows[ok], cells[ok], then[ok]
        a, b = ids[rows, cells], ids[rows, then]
        got = vocab.pair(a, b)
        hit = np.flatnonzero(got >= 0)
        if dropout or met is not None:
            candidate = _candidate(a[hit], b[hit], cells[hit])
            if met is not None:
                met.append((words[rows[hit]], candidate))
            hit = hit[~_skipped(candidate, draws[rows[hit]], dropout, seed)]
        rank[rows, cells] = _NONE
        rank[rows[hit], cells[hit]] = vocab.rank[got[hit]]
        made[rows[hit], cells[hit]] = got[hit]

    consider(*(x.ravel() for x in np.nonzero(np.arange(width) < (lengths - 1)[:, None])))
    live = np.arange(n)
    while len(live):
        cells = rank[live].argmin(1)
        go = rank[live, cells] != _NONE
        live, cells = live[go], cells[go]
        if not len(live):
            break
        gone = after[live, cells]
        then = after[live, gone]
        ids[live, cells] = made[live, cells]
        kept[live, gone], rank[live, gone], after[live, cells] = False, _NONE, then
        some = then < width
        before[live[some], then[some]] = cells[some]
        prior = before[live, cells]
        some = prior >= 0
        consider(live[some], prior[some])
        consider(live, cells)
    return kept


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _to_bytes(vocab: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write characters without a piece (-1 - code point) as byte pieces."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, sizes
    raw = [chr(-1 - x).encode() for x in ids[bare].tolist()]
    times = np.ones(len(ids), np.int64)
    times[bare] = [len(x) for x in raw]
    out = np.repeat(ids, times)
    out[out < 0] = vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(sizes)), sizes)
    return out, np.bincount(word, times, minlength=len(sizes)).astype(np.int64)


def _by_word(met: list[tuple[np.ndarray, np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that ``merge_words`` met, one word after the other, and how many each word has."""
    of, candidates = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return candidates[np.argsort(of, kind="stable")], np.bincount(of, minlength=words)


def _decisions(candidates: np.ndarray, counts: np.ndarray, kind: np.ndarray, draws: np.ndarray, dropout: float, seed: int, at_once: int = 1 << 16) -> np.ndarray:
    """For every occurrence of a word, a hash of the set of the word's candidates that it skips; 0: none."""
    first, out = np.cumsum(counts) - counts, np.zeros(len(kind), np.uint64)
    for at in range(0, len(kind), at_once):
        k, n = kind[at:at + at_once], counts[kind[at:at + at_once]]
        of = np.repeat(np.arange(len(k)), n)
        found = candidates[_ragged(first[k], n)]
        skip = _skipped(found, draws[at:at + at_once][of], dropout, seed)
        with np.errstate(over="ignore"):
            np.add.at(out, at + of[skip], mix(found[skip] + np.uint64(1)) | np.uint64(1))
    return out


def merge_occurrences(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray, kind: np.ndarray, draws: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence (of word ``kind``, with its draw) merged: symbols left, how many each result has, and the result of each occurrence.

    An agenda depends on the draw only through the candidates it meets. So an
    occurrence that decides all candidates met by another one's agenda in the
    same way has that agenda, and equal results need not be computed again.
    """
    if not dropout:
        return *merge_words(vocab, symbols, lengths, np.zeros(len(lengths), np.uint64), 0, seed), kind
    first = np.cumsum(lengths) - lengths

    def merge(words: np.ndarray, own: np.ndarray, chance: float, met=None) -> tuple[np.ndarray, np.ndarray]:
        return merge_words(vocab, symbols[_ragged(first[words], lengths[words])], lengths[words], own, chance, seed, met)

    result, parts, done = np.full(len(kind), -1, np.int64), [], 0
    often = (np.bincount(kind, minlength=len(lengths)) >= SHARED_FROM) & (lengths <= LONG_WORD)
    some = np.flatnonzero(often[kind])
    if len(some):
        words, number = np.flatnonzero(often), np.cumsum(often) - 1
        met: list[tuple[np.ndarray, np.ndarray]] = []
        parts.append(merge(words, np.zeros(len(words), np.uint64), 0, met))
        own = number[kind[some]]
        skips = _decisions(*_by_word(met, len(words)), own, draws[some], dropout, seed)
        plain = skips == 0
        result[some[plain]], done = own[plain], len(words)
        # The others: those that skip the same of these candidates probably decide alike; compared with the first of them.
        some, skips, own = some[~plain], skips[~plain], own[~plain]
        with np.errstate(over="ignore"):
            _, rep, group, size = np.unique(skips + mix(own.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True, return_counts=True)
        shared = size > 1
        if shared.any():
            lead, number = some[rep[shared]], np.cumsum(shared) - 1
            met = []
            parts.append(merge(kind[lead], draws[lead], dropout, met))
            members = np.flatnonzero(shared[group])
            of, found = number[group[members]], _by_word(met, len(lead))
            alike = (_decisions(*found, of, draws[some[members]], dropout, seed) == _decisions(*found, np.arange(len(lead)), draws[lead], dropout, seed)[of])
            result[some[members[alike]]] = done + of[alike]
            done += len(lead)
    alone = np.flatnonzero(result < 0)
    if len(alone):
        parts.append(merge(kind[alone], draws[alone], dropout))
        result[alone] = done + np.arange(len(alone))
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), result


def encode_texts(vocab: Vocabulary, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each text has; ``keys``: a 64-bit key of each text's row."""
    texts = len(bounds) - 1
    sizes = np.diff(bounds)
    some = sizes > 0
    shift = np.cumsum(some)
    spaced = np.full(len(data) + int(some.sum()), 32, np.uint8)  # every text starts with a space
    spaced[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    begins = (bounds[:-1] + shift - 1)[some]
    if not len(spaced):
        return np.zeros(0, np.int32), np.zeros(texts, np.int64)
    space, line = spaced == 32, spaced == 10
    cut = np.zeros(len(spaced), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(spaced)))
    up, _ = powers(int(lengths.max()) + 1)
    place = np.arange(len(spaced)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(_CODES[spaced] * up[place], starts) + lengths.astype(np.uint64))
        per_text = np.zeros(texts, np.int64)
        per_text[some] = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        owner = np.repeat(np.arange(texts), per_text)
        occurrence = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        draws = mix(mix(keys.view(np.uint64)[owner] + np.uint64(seed)) + occurrence.astype(np.uint64))
        _, rep, kind = np.unique(hashes, return_index=True, return_inverse=True)
    raw = spaced[_ragged(starts[rep], lengths[rep])]
    chars = np.add.reduceat((raw & 0xC0) != 0x80, np.cumsum(lengths[rep]) - lengths[rep]).astype(np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    symbols = vocab.of_char[points]
    symbols = np.where(symbols < 0, -1 - points, symbols).astype(np.int32)
    ids, left, result = merge_occurrences(vocab, symbols, chars, kind, draws, dropout, seed)
    ids, left = _to_bytes(vocab, ids, left)
    out = ids[_ragged((np.cumsum(left) - left)[result], left[result])]
    return out, np.bincount(owner, left[result], minlength=texts).astype(np.int64)


def decode_texts(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, and how many each has; whole texts of about ``DECODE_IDS`` ids at a time."""
    ends, parts, row = np.cumsum(counts), [], 0
    while row < len(counts):
        begin = int(ends[row] - counts[row])
        end = max(row + 1, int(np.searchsorted(ends, begin + DECODE_IDS, "right")))
        parts.append(_decode_part(vocab, ids[begin:int(ends[end - 1])], counts[row:end]))
        row = end
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _decode_part(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(vocab.piece_ends)[ids]
    raw = vocab.piece_bytes[_ragged(vocab.piece_ends[ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
    per_text = np.diff(np.concatenate([[0], ends]))
    first = ends - per_text
    keep = np.ones(len(raw), bool)
    keep[first[per_text > 0]] = False  # the space before every text
    return raw[keep], per_text - (per_text > 0)


def encode(df: DataFrame, path: str = PIECE_MODEL, text: str = "text", key: str = "doc_id", dropout: float = DROPOUT, seed: int = SEED, column: str = "piece_ids") -> DataFrame:
    """``df`` with the ids of each whole text in ``column`` (array of int)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    kept = df.drop(column)
    keyed = kept.withColumn(unused(kept, "_key"), F.xxhash64(key))
    at = kept.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_keys = batch.column(len(batch.columns) - 1).to_numpy()
            for lo, hi, data, bounds in text_chunks(batch.column(at), ENCODE_BYTES):
                ids, counts = encode_texts(shared.value, data, bounds, row_keys[lo:hi], dropout, seed)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)), mask=batch.column(at)[lo:hi].is_null())
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), lists], names=[*batch.schema.names[:-1], column])

    return keyed.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, ArrayType(IntegerType()))]))


def decode(df: DataFrame, path: str = PIECE_MODEL, ids: str = "piece_ids", column: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids in ``column``."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    kept = df.drop(column)
    at = kept.columns.index(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            counts = np.nan_to_num(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))).astype(np.int64)
            raw, sizes = decode_texts(shared.value, lists.flatten().to_numpy(), counts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())
            texts = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, StringType())]))
