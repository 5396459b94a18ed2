import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from merchlens.llm import periodic_runs as P
from merchlens.llm import queries

WORD = r"[^\x20\x09-\x0D]+"


def brute(w):
    """Every maximal stretch of every period, without those that have a smaller one."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start >= max(24, 3 * q) and not any(all(w[x] == w[x - p] for x in range(start + p, i)) for p in range(1, q)):
                out.append((start, i - start, q))
    return sorted(out)


def sample(rng):
    out = []
    for _ in range(rng.randint(1, 5)):
        kinds = rng.choice([1, 2, 2, 3, 20])
        part = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 12))]
        out += part * rng.choice([1, 1, 2, 3, 4, 8, 15]) + [f"v{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 3, 30]))]
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_against_brute_force():
    rng = random.Random(3)
    found = 0
    for i in range(2000):
        w = sample(rng)
        expected = brute(w)
        found += len(expected)
        assert P.find_runs(w) == expected, w
        if i % 4 == 0:  # without the cut into blocks
            ids = {}
            assert sorted(P.block_runs([ids.setdefault(x, len(ids)) for x in w])) == expected
    assert found > 1000


@pytest.mark.parametrize("w", [fibonacci(600), ["a"] * 100, ["a", "b"] * 40, (["a"] * 30 + ["b"]) * 4, (["x", "y", "x"] * 9 + ["z"]) * 3, ["a"] * 23, ["a"] * 24, list("abcdefgh") * 3, list("abcdefghi") * 3])
def test_nested_and_short_runs(w):
    assert P.find_runs(w) == brute(w)


def test_one_segment_shows_a_run():
    automaton = P.RecolouredAutomaton()
    seen = [automaton.append(x) for x in [1, 2, 1, 2, 1, 2]]
    assert seen[0] == [] or all(n == 0 for _, n in seen[0])
    assert (3, 4) in seen[5]  # 2 1 2 ... : four words end at 5 and ended at 3


def test_recolouring_stays_small():
    """O(n log n) segments, on a text made to repeat at every scale."""
    for w in (fibonacci(5000), [i.bit_count() % 2 for i in range(5000)], [0] * 5000):
        automaton, ids = P.RecolouredAutomaton(), {}
        assert sum(len(automaton.append(ids.setdefault(x, len(ids)))) for x in w) < 13 * len(w)


def test_a_block_holds_a_whole_run():
    rng = random.Random(8)
    for _ in range(300):
        w = sample(rng)
        ids = {}
        import numpy as np
        parts = list(P.blocks(np.array([ids.setdefault(x, len(ids)) for x in w])))
        for start, length, _ in brute(w):
            assert any(a <= start and start + length <= b for a, b in parts)


def modified(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = modified(doc_id, re.findall(WORD, text or ""))
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(sample(rng)).replace("v1 ", rng.choice(["\n", "\t\t", "v1 "]))) for i in range(250)] + [(250, None), (251, ""), (252, " \n"), (253, "a " * 30), (253, "a " * 30), (None, "b " * 30), (254, "é 🙂 " * 15)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)


def test_query_on_documents(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        if len(t or "") < 6000:
            assert got[d] == expected(d, t)


def test_operator_keeps_rows_and_columns(spark, odd, none):
    frame = odd.withColumns({"runs": F.lit(1), "t": F.lit(2), "c1": F.lit(3)})
    out = P.periodic_runs(frame)
    assert sorted(out.columns) == sorted({*frame.columns, "n_words", "runs", "collapsed"}) and out.count() == odd.count()
    assert P.periodic_runs(none).collect() == []
    for r in out.collect():
        words = re.findall(WORD, r["text"] or "")
        assert r["n_words"] == len(words) and (r["runs"] or r["collapsed"] == " ".join(words))
