"""Word splitting and hashing over whole Arrow columns, without a Python object per word.

Words are maximal runs of "word bytes"; both word patterns of the operators
are unions of ASCII bytes and all non-ASCII code points, so they can be cut on
the UTF-8 bytes. Upper-case A-Z share the hash code of a-z, which lower-cases
exactly these letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# One numpy pass handles about this many bytes; longer texts are cut at separators.
SEGMENT_BYTES = 1 << 20
# One chunk of documents handed to an operator holds about this many bytes (one document at least).
CHUNK_BYTES = 2 << 20

_RADIX = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and a random 64-bit code per byte."""

    is_word: np.ndarray
    code: np.ndarray


def _alphabet(separators: set[int]) -> Alphabet:
    is_word = np.ones(256, bool)
    is_word[sorted(separators)] = False
    code = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64)
    code[65:91] = code[97:123]
    return Alphabet(is_word, code)


# `[^\x20\x09-\x0D]+`
SPACED = _alphabet({0x20, *range(0x09, 0x0E)})
# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z
ALNUM = _alphabet(set(range(0x00, 0x30)) | set(range(0x3A, 0x41)) | set(range(0x5B, 0x61)) | set(range(0x7B, 0x80)))

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            out = np.full(max(n, SEGMENT_BYTES), base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.cumprod(out, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _segment(data: np.ndarray, breaks: np.ndarray, alphabet: Alphabet):
    word = alphabet.is_word[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(alphabet.code[data] * up[:len(data)], out=total[1:])
        hashes = (total[ends] - total[starts]) * down[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, starts, ends


def hash_words(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet):
    """Hash, start and end of every word of the texts ``data[bounds[i]:bounds[i + 1]]``; words don't cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT_BYTES)
        if end < len(data):
            gaps = np.flatnonzero(~alphabet.is_word[data[at:end]])
            cuts = bounds[(bounds > at) & (bounds <= end)]
            cut = max(int(gaps[-1]) + at + 1 if len(gaps) else 0, int(cuts[-1]) if len(cuts) else 0)
            if cut <= at:  # one word longer than a segment: go on to where it ends
                step = np.flatnonzero(~alphabet.is_word[data[end:]])
                later = bounds[bounds > end]
                cut = min(end + int(step[0]) if len(step) else len(data), int(later[0]) if len(later) else len(data))
            end = cut
        h, s, e = _segment(data[at:end], bounds - at, alphabet)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets."""
    data, bounds = text_bytes(column)
    at, rows = 0, len(bounds) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end, data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        at = end


def word_counts(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text, from the words' starts."""
    return np.diff(np.searchsorted(starts, bounds))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (len - n + 1 values, also across texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(size, n, np.uint64)
        for i in range(n):
            out = (out ^ hashes[i:i + size]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out
