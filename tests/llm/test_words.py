import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from merchlens.llm import words

ANY = st.text(alphabet=st.sampled_from(list("abAZ09 \t\n\r\x0b\x0c\x00.-é日🙂\x85\xa0")), max_size=40)
PATTERNS = {"SPACED": r"[^\x20\x09-\x0D]+", "ALNUM": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(ANY, max_size=6), st.sampled_from(sorted(PATTERNS)), st.sampled_from([3, 7, 1 << 20]))
def test_words_as_the_pattern_says(texts, name, segment):
    data, bounds = words.text_bytes(pa.array(texts, pa.string()))
    keep, words.SEGMENT_BYTES = words.SEGMENT_BYTES, segment
    try:
        hashes, starts, ends = words.hash_words(data, bounds, getattr(words, name))
    finally:
        words.SEGMENT_BYTES = keep
    want = [re.findall(PATTERNS[name], t.translate(LOWER)) for t in texts]
    got = [data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(starts, ends)]
    assert got == [w for t in want for w in t]
    assert words.word_counts(starts, bounds).tolist() == [len(t) for t in want]
    assert len(set(zip(hashes.tolist(), got))) == len(set(got)) == len(set(hashes.tolist()))


def test_chunks_hold_whole_texts():
    column = pa.array(["aa", None, "b" * 50, "", "c"])
    parts = list(words.text_chunks(column, 10))
    assert [(lo, hi) for lo, hi, *_ in parts][0][0] == 0 and parts[-1][1] == 5
    assert b"".join(d.tobytes() for *_, d, _ in parts) == b"aa" + b"b" * 50 + b"c"


def test_sliced_column():
    column = pa.array(["xx", "yy zz", None, "w"]).slice(1)
    data, bounds = words.text_bytes(column)
    assert data.tobytes() == b"yy zzw" and bounds.tolist() == [0, 5, 5, 6]


def test_rolling_tells_lengths_apart():
    h = np.arange(1, 6, dtype=np.uint64)
    assert len(words.rolling(h, 3)) == 3 and len(words.rolling(h, 6)) == 0
    assert words.rolling(h[:2], 2)[0] not in words.rolling(h, 3)
