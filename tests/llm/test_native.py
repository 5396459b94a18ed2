"""Quality rules, sharding and chat formatting: built-in functions only."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merchlens.llm import chat_format as C
from merchlens.llm import quality_rules as Q
from merchlens.llm import queries, sharding

WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ quality rules
def base(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_counts(spark, odd, texts):
    rng = random.Random(1)
    rows = [*texts.values(), *("".join(rng.choice(["a ", "b ", "é", "\n", "a b c\n", "#", "\t", " \r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150))]
    made = Q.quality_rules(spark.createDataFrame([(t,) for t in rows], "text string").union(odd.select("text")))
    for r in made.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["base_failed"] and not r["failed_rules"])


def test_rules_are_data(spark):
    df = spark.createDataFrame([("the of and to " * 20 + " ".join(f"w{i}" for i in range(60)),), ("x " * 90,), (" ".join(f"### w{i}" for i in range(80)),)], "text string")
    got = [r["failed_rules"] for r in Q.quality_rules(df).collect()]
    assert "repeats" in got[1] and "stop_words" in got[1] and "symbols" in got[2]
    loose = Q.quality_rules(df, rules=[("length", "n_words", "one", 1, None)]).collect()
    assert [r["failed_rules"] for r in loose] == [[], [], []]


def test_quality_is_one_projection(spark, odd, none):
    plan = Q.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    out = Q.quality_rules(odd.withColumn("_q", F.lit(1)))
    assert "_q" in out.columns and out.count() == odd.count() and Q.quality_rules(none).collect() == []


# ----------------------------------------------------------------------- sharding
def checked(df, keys, size, **how):
    names = df.columns
    rows = sharding.shard_rows(df, keys, size, **how).collect()
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(tuple(r) for r in df.collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sums = {k: sum(r[size] for r in part) for k, part in by.items()}
    total, most = sum(sums.values()), max((r[size] for r in rows), default=0)
    assert all(abs(s - total / how.get("shards", 8)) <= most + 1 for s in sums.values())
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    ks = [tuple((r[k] is not None, r[k]) for k in keys) for r in order]
    assert ks == sorted(ks)  # shards are ranges of the keys
    return rows


def test_shards_are_even_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(300)]), i, rng.choice([1, 5, 40, 900])) for i in range(3000)]
    checked(spark.createDataFrame(rows, "k bigint, id bigint, size bigint").repartition(4), ["k", "id"], "size")


@pytest.mark.parametrize("hot", ["key", "row"])
def test_hot_keys_are_cut(spark, hot):
    rows = [(1, 0 if hot == "row" else i, 7) for i in range(4000)] + [(i % 50, i, 1 + i % 90) for i in range(1500)]
    got = checked(spark.createDataFrame(rows, "k bigint, id bigint, size bigint"), ["k", "id"], "size", shards=5)
    assert len({r["shard"] for r in got if r["k"] == 1}) > 1


def test_overfull_ranges_are_subdivided(spark):
    rows = [(i, 1) for i in range(4000)] + [(10_000 + i, 50) for i in range(400)]
    got = checked(spark.createDataFrame(rows, "k bigint, size bigint"), ["k"], "size", ranges=16, draws=16)
    sums = Counter()
    for r in got:
        sums[r["range"]] += r["size"]
    assert max(sums.values()) <= 2 * sum(sums.values()) / 16 + 50


def test_shard_query(spark, sf, texts):
    rows = queries.op5_sharding(spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}


def test_shard_query_against_brute_force(spark, sf, texts):
    """Shard, slot and balance of every document, from one sorted list."""
    import xxhash

    def key(i):
        t = texts[i]
        h = xxhash.xxh64_intdigest(t.encode(), seed=42) if t is not None else 42
        return h - (1 << 64) if h >= 1 << 63 else h, i

    size = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    total, at, slots, want = sum(size.values()), 0, Counter(), {}
    for i in sorted(texts, key=key):
        shard = min(7, (2 * at + size[i]) * 8 // (2 * total))
        want[i] = (shard, slots[shard])
        slots[shard] += 1
        at += size[i]
    rows = queries.op5_sharding(spark, sf).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == want
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    per_shard = Counter()
    for r in rows:
        per_shard[r["shard"]] += r["size"]
    assert max(per_shard.values()) - min(per_shard.values()) <= 2 * max(size.values())


def test_shards_keep_every_column(spark):
    """Columns named as the operator's own ones, and a third of the sizes null."""
    rows = [(i % 40, None if i % 3 == 0 else i % 50, i, i + 1, i + 2, i + 3, i + 4, i + 5, i + 6, i + 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, size bigint, _n int, _r int, _c int, c0 int, bytes int, shard int, slot int, `range` int")
    out = sharding.shard_rows(df, ["k"], "size", shards=4)
    assert sorted(out.columns) == sorted(df.columns)
    kept = ["k", "size", "_n", "_r", "_c", "c0", "bytes"]
    assert sorted(map(tuple, out.select(*kept).collect()), key=repr) == sorted((r[:7] for r in rows), key=repr)
    sums = Counter()
    for r in out.collect():
        sums[r["shard"]] += r["size"] or 0
    assert max(sums.values()) - min(sums.values()) <= 100
    assert sharding.shard_rows(df.withColumn("size", F.lit(None).cast("bigint")), ["k"], "size").count() == 300


def test_turn_order_stands_in_the_query(spark, sf):
    """The state machine's transitions are part of the query's plan, and of its result."""
    df = queries.op6_chat_format(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "user>assistant" in plan and "assistant>user" in plan
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in df.collect()}
    assert got[-7] == (True, None) and len({v for v, _ in got.values()}) == 2


def test_odd_shards(odd, none):
    for df in (odd, none):
        rows = df.select("doc_id", "lang", F.col("source").alias("bytes"), F.lit(3).cast("bigint").alias("size"))
        assert sharding.shard_rows(rows, ["doc_id"], "size").count() == df.count()


# ------------------------------------------------------------------ chat formatting
CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", "[INST] x [/INST]</s>"), (2, 0, "user", r"[\INST] [\\INST]<\s><s>"),
         (3, 0, "system", "s"), (3, 1, "user", None), (3, 2, "assistant", ""), (3, 3, "tool", "[TOOL]"), (3, 4, "assistant", "é🙂"), (4, 0, None, "t"),
         (4, 1, "[TEXT]odd role", "[ROLE][/ROLE][TEXT]"), (5, 0, "user", "a"), (5, 1, "user", "b"), (None, 0, "user", "n"), (6, None, "user", "first"), (6, 0, "assistant", "x"),
         (7, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "assistant", "z"), (8, 0, "assistant", "<<s>[[SYS]/SYS]"), (9, 0, "user", "")]


def test_read_back_what_was_written(spark):
    rng = random.Random(5)
    bits = ["[", "]", "<", ">", "/", "\\", "s", "INST", "[INST]", "</s>", "[BOT] ", "TEXT]", "\n", "é", "[\\\\SYS]"]
    chats = CHATS + [(100 + i, k, rng.choice(["user", "assistant", "system", "x" + "".join(rng.choices(bits, k=3))]), "".join(rng.choices(bits, k=rng.randint(0, 9))))
                     for i in range(60) for k in range(rng.randint(1, 5))]
    df = spark.createDataFrame([(*c, 1) for c in chats], "conv_id bigint, turn bigint, role string, text string, turns int")
    made = C.format_chats(df)
    rows = made.select("*", C.read_turns(F.col("formatted")).alias("read"), F.transform("segments", lambda s: F.struct(s["loss"].alias("loss"), C.unescape(s["text"]).alias("text"))).alias("plain")).collect()
    want = {}
    for c, turn, role, text in sorted(chats, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"] for r in rows} == set(want)
    for r in rows:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["read"]] == turns
        assert [s["text"] for s in r["plain"] if s["loss"]] == [t for role, t in turns if role == "assistant"]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_turn_order(spark):
    df = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in C.format_chats(df).collect()}
    assert got[1] == got[2] == got[3] == (True, None)
    assert got[4] == (False, 0) and got[5] == (False, 1) and got[9] == (False, None) and got[8] == (False, 0)
    assert C.format_chats(df.limit(0)).collect() == []


def test_chat_query_has_the_probe(spark, sf):
    row = queries.op6_chat_format(spark, sf).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_native_plans_run_no_python(spark, sf):
    for name in ("op5_sharding", "op6_chat_format"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan), plan
