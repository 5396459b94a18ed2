import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from merchlens.llm import files, kneser_ney, queries


def tokens(text):
    return [*(text or "").encode().lower().split(), 1]


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.bi.update(zip([0, *w], w))
        self.N, self.V = sum(self.uni.values()), len(self.uni)
        self.before = Counter(w for _, w in self.bi)
        self.after, self.total = defaultdict(Counter), Counter()
        for (u, _), c in self.bi.items():
            self.after[u][min(c, 3)] += 1
        for (u, _), c in self.bi.items():
            self.total[u] += c
        self.high, self.low = ([0, *kneser_ney.discounts(*(sum(v == k for v in counts) for k in (1, 2, 3, 4)))]
                               for counts in (list(self.bi.values()), list(self.before.values())))
        self.rest = sum(self.low[min(c, 3)] for c in self.before.values()) / max(len(self.bi), 1)

    def p(self, u, w):
        c = self.before[w]
        low = (c - self.low[min(c, 3)]) / len(self.bi) + self.rest / (self.V + 1)
        if not self.total[u]:
            return low
        n = self.bi[u, w]
        return (n - self.high[min(n, 3)]) / self.total[u] + sum(self.high[k] * m for k, m in self.after[u].items()) / self.total[u] * low

    def scores(self, text):
        w = tokens(text)
        return (len(w), sum(self.uni[x] > 0 for x in w), self.N, sum(math.log10((self.uni[x] + .5) / (self.N + .5 * (self.V + 1))) for x in w),
                sum(math.log10(self.p(u, x)) for u, x in zip([0, *w], w)))


def same(row, want):
    got = (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"])
    return got[:3] == want[:3] and np.allclose(got[3:], want[3:], rtol=1e-6)


def test_query_against_brute_force(spark, sf, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    brute = Brute(t for i, t in texts.items() if not held[i])
    rows = queries.op8_kneser_ney(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == held[r["doc_id"]] and same(r, brute.scores(texts[r["doc_id"]]))
    # One distribution over the training tokens and one unseen token.
    for u in (0, max(brute.uni, key=brute.uni.get), b"never seen"):
        assert abs(sum(brute.p(u, w) for w in brute.uni) + brute.p(u, b"never") - 1) < 1e-9


def test_many_shards_and_frequent_contexts(spark, texts, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", 0.005)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    model = kneser_ney.fit(docs, shard_tokens=5000)
    assert len(model.bigrams) > 5 and len(model.hot) > 3
    brute = Brute(texts.values())
    assert (model.tokens, model.kinds, model.pairs) == (brute.N, brute.V, len(brute.bi))
    monkeypatch.undo()
    assert all(same(r, brute.scores(texts[r["doc_id"]])) for r in kneser_ney.score(docs, model).collect())


def test_counts_over_a_byte(spark):
    rows = ["a b " * 400, "a b a c", "b"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    brute = Brute(rows)
    assert all(same(r, brute.scores(r["text"])) for r in kneser_ney.score(docs, kneser_ney.fit(docs)).collect())


def test_odd_rows(odd, none):
    rows = odd.select("text").collect()
    brute = Brute(r["text"] for r in rows)
    out = kneser_ney.score(odd, kneser_ney.fit(odd))
    got = out.collect()
    assert len(got) == len(rows) and all(same(r, brute.scores(r["text"])) for r in got)
    assert kneser_ney.score(none, kneser_ney.fit(none)).collect() == []
    untrained = kneser_ney.score(odd, kneser_ney.fit(none)).collect()
    assert {(r["base_score"], r["score"], r["n_known"]) for r in untrained} == {(0.0, 0.0, 0)}


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_files(tmp_path, prefix):
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.float32), np.array([1, 2, 3], np.uint8), np.array([7], np.uint32)]
    path = files.write_file(f"{prefix}{tmp_path}/a/b", files.arrays_to_bytes(arrays))
    got = files.arrays_from(files.map_file(path))
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, got))
    assert files.write_file(f"{prefix}{tmp_path}/a/b", [b""]) != path
