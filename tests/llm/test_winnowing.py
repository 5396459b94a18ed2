import random
import re

import numpy as np
import pytest

from merchlens.llm import winnowing as W

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PATTERN, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - 12)) if x else ():
            window = x[i:i + 13]
            for s in range(len(w) - len(window) + 1):
                if w[s:s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [W.BROADCAST_LIMIT, 0])
def test_against_brute_force(spark, limit):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([1, 3, 12, 13, 14, 20, 40])))) for i in range(30)]
    items += [(10, items[3][1]), (None, "zz yy xx"), (77, None), (78, " .. "), (5, "other words of a repeated id")]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [", ".join(w[a:a + rng.choice([5, 12, 13, 20, 60])]).upper(), " ".join(rng.choice("klmn") for _ in range(rng.randint(0, 9)))]
        texts.append(" - ".join(parts))
    texts += [None, "", "zz yy xx", texts[0], texts[1] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = W.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_limit=limit).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in out}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}


def test_shared_spans_share_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(100):
        span = rng.integers(0, 5, 13, dtype=np.uint64)
        fps = []
        for _ in range(2):
            h = np.concatenate([rng.integers(5, 9, rng.integers(0, 20), dtype=np.uint64), span, rng.integers(5, 9, rng.integers(0, 20), dtype=np.uint64)])
            grams, at, _ = W.winnow(h, np.zeros(len(h), int), 13, 5)
            fps.append(set(grams[at].tolist()))
        assert fps[0] & fps[1]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "sat on the mat and then it went to the other house", 3), (2, "", 3)], "item_id bigint, text string, fp int")
    rows = W.decontaminate(odd, items).collect()
    assert len(rows) == odd.count()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in rows if r["doc_id"] == 1] == [(14, 12, True)] * 2
    assert W.decontaminate(none, items).collect() == []
    assert all(not r["contaminated"] and r["item_ids"] == [] for r in W.decontaminate(odd, items.limit(0)).collect())
