import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.llm import components as C
from merchlens.llm import jaccard_join as J
from merchlens.llm import queries
from merchlens.llm.components import components
from merchlens.llm.shared import Scratch

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k=3, percent=90):
    """(size, least id reachable) of every id, from all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_all_pairs(spark, sf, texts):
    assert got(queries.op1_jaccard_join(spark, sf)) == brute(texts)


def near_copies(rng, base, copies, step):
    """A chain in which each text differs a little from the one before."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    for _ in range(copies):
        yield " ".join(words)
        for _ in range(step):
            words[rng.randrange(base)] = f"n{rng.randrange(10**6)}"


@pytest.mark.parametrize("block, elements, few, pairs", [(1024, 1 << 19, 2, 4), (16, 1 << 19, 1, 0), (1024, 3000, 1, 10**9)])
def test_chains_and_groups(spark, monkeypatch, block, elements, few, pairs):
    """Also with blocks so small that a tile has many, with one round, and then by arrays or by pairs alone."""
    for name, value in (("BLOCK", block), ("BLOCK_ELEMENTS", elements), ("FEW", few), ("PAIRS", pairs)):
        monkeypatch.setattr(J, name, value)
    rng, texts = random.Random(4), {}
    for base, copies, step in ((12, 8, 1), (30, 10, 1), (200, 60, 2), (200, 40, 4), (900, 15, 9), (10, 6, 1), (11, 6, 1)):
        for t in near_copies(rng, base, copies, step):
            texts[len(texts)] = t
    words = [f"t{i}" for i in range(400)]  # copies of one text, each with a word of its own: all linked by the first
    for i in range(80):
        texts[len(texts)] = " ".join([*words[:i * 4], f"own{i}", *words[i * 4 + 1:]])
    template = [f"s{i}" for i in range(100)]  # a shared passage in texts that aren't linked
    for i in range(60):
        texts[len(texts)] = " ".join(template + [f"u{i}-{k}" for k in range(25)])
    texts |= {1000 + i: t for i, t in texts.items() if i % 9 == 0}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert got(J.jaccard_classes(df)) == brute(texts)


@pytest.mark.parametrize("sizes", [(9, 10), (10, 10), (12, 13), (18, 20), (95, 100), (90, 100), (450, 500), (1000, 1000)])
@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_tile(sizes, percent):
    """Sets just at the threshold."""
    rng, bands = np.random.default_rng(sum(sizes)), J.Bands(percent, 100)
    for _ in range(60):
        n, m = sizes
        common = -(-percent * (n + m) // (100 + percent))
        if common > min(n, m):
            continue
        pool = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:n + m - common]]))
        if 100 * common >= percent * (n + m - common) and n != common:
            a, b = (set(J.tile_keys(s, J._sums(s), bands).tolist()) for s in (x, y))
            assert a & b


def test_bands_leave_no_gap():
    for a, b in ((90, 100), (80, 100), (95, 100)):
        bands = J.Bands(a, b)
        for t in range(1, 3000):
            for s in range(-(-a * t // b), t + 1):
                if s < t or t >= bands.low(0):
                    tiles = {i for i, *_ in bands.of(s)} & {i for i, *_ in bands.of(t)}
                    assert tiles and all(p - c >= (s + t) * (b - a) // (b + a) and c > 0 for i, p, c in bands.of(t) if i in tiles)


def test_five_words_and_four_fifths(spark, texts):
    rng, all_texts = random.Random(8), dict(texts)
    for base, step in ((60, 1), (8, 1), (12, 1), (150, 3), (400, 8)):
        for t in near_copies(rng, base, 15, step):
            all_texts[10_000 + len(all_texts)] = t
    df = spark.createDataFrame(list(all_texts.items()), "doc_id bigint, text string")
    found = got(J.jaccard_classes(df, n=5, threshold=(80, 100)))
    assert found == brute(all_texts, 5, 80)
    assert len({c for i, (_, c) in found.items() if i >= 10_000}) < 40


def test_sets_with_many_empty_parts_meet():
    """Two linked sets whose elements lie in few parts share the tile of such sets."""
    bands = J.Bands(80, 100)
    x = np.arange(100, dtype=np.uint64)
    y = np.concatenate([x[:95], x[95:] + np.uint64(1000)])
    a, b = (set(J.tile_keys(s, J._sums(s), bands).tolist()) for s in (x, y))
    assert a & b


def test_odd_rows(odd, none):
    out = J.jaccard_classes(odd)
    rows = out.collect()
    assert out.columns == ["doc_id", "text_key", "n_shingles", "component_id"] and len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (2, 3, 5):
            assert (r["n_shingles"], r["component_id"]) == (0, r["doc_id"])
    assert [(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] == 1] == [(12, 1), (12, 1)]
    assert J.jaccard_classes(none).collect() == []


@pytest.mark.parametrize("small", [0, 100_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    rng, edges = random.Random(1), [(i, i + 1) for i in range(40)]
    edges += [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    with Scratch(spark, "test") as scratch:
        assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()} == want


def test_nothing_is_left_but_what_the_result_reads(spark, texts):
    """Intermediate tables are deleted: two tables of a row a document or set stay."""
    import os
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    out = J.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    left = {d.rsplit("-", 1)[0] for d in set(os.listdir(base)) - before}
    assert left == {"jaccard-sets", "jaccard-roots"} and out.count() == len(texts)


def test_tiles_with_equal_members_are_compared_once(spark):
    """A pair meets in one of the tiles that hold the same sets, and in every tile that holds others as well."""
    tiles = {1: (10, 20), 2: (10, 20), 3: (10, 20, 30), 4: (10, 30), 5: (40, 50), 6: (20, 30)}
    members = spark.createDataFrame([(t, s) for t, sets in tiles.items() for s in sets], "tile bigint, set_id bigint")
    roots = spark.createDataFrame([(s, 100 + s, 40 if s >= 40 else s) for s in (10, 20, 30, 40, 50)], "set_id bigint, n bigint, root bigint")
    left = {}
    for r in J._open_tiles(members, roots).collect():
        left.setdefault(r["tile"], set()).add((r["set_id"], r["held"], r["most"]))
    assert sorted(sorted(s for s, *_ in v) for v in left.values()) == [[10, 20], [10, 20, 30], [10, 30], [20, 30]]
    assert all(held == len(v) and most == 100 + max(s for s, *_ in v) for v in left.values() for _, held, most in v)


def test_only_asked_arrays_are_sent(spark):
    sets = spark.range(5000).select(F.col("id").alias("set_id"), F.lit("x").alias("elements"))
    ids = spark.createDataFrame([(i * 100,) for i in range(20)], "set_id bigint")
    kept = {r[0] for r in J._asked(sets, ids).select("set_id").collect()}
    assert kept >= {i * 100 for i in range(20)} and len(kept) < 500
