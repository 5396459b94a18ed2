import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from merchlens.llm import conversation_repair as C
from merchlens.llm import queries

GOOD = re.compile(r"(s?(ua)+)?")


def every_audit(kinds, most):
    """All (cost, audit) of edit sequences with at most ``most`` inserts whose roles are legal."""
    out = []

    def go(i, roles, cost, edits, inserts):
        if i == len(kinds) and GOOD.fullmatch(roles):
            out.append((cost, edits))
        if inserts < most:
            for r in "ua":
                go(i, roles + r, cost + 3, edits + "I", inserts + 1)
        if i < len(kinds):
            k = kinds[i]
            go(i + 1, roles, cost + 4, edits + "D", inserts)
            if not k.gone:
                more = 3 if k.truncated else 0
                go(i + 1, roles + (k.initial or "x"), cost + more, edits + "K", inserts)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + more, edits + "R", inserts)

    go(0, "", 0, "", 0)
    return out


def test_against_every_edit_sequence():
    rng = random.Random(2)
    for _ in range(250):
        kinds = tuple(C.Kind(rng.choice(["s", "u", "a", ""]), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randint(0, 4)))
        assert C.audit(kinds) == min(every_audit(kinds, 4)), kinds


def dp(kinds):
    """(cost, audit) of every state behind each turn, from the last turn."""
    def insert(v):
        return v[0] + 3, "I" + v[1]

    v = [(0, ""), (6, "II"), (3, "I"), (0, "")]
    for k in reversed(kinds):
        x = []
        for s in range(4):
            to, more = (3 if s == 2 else 2), (3 if k.truncated else 0)
            best = [(v[s][0] + 4, "D" + v[s][1])]
            if not k.gone:
                best.append((v[to][0] + 3 + more, "R" + v[to][1]))
                best += [(v[to][0] + more, "K" + v[to][1])] if k.initial == "ua"[to - 2] else []
                best += [(v[1][0] + more, "K" + v[1][1])] if s == 0 and k.initial == "s" else []
            x.append(min(best))
        two, three = min(x[2], insert(x[3])), min(x[3], insert(x[2]))
        v = [min(x[0], insert(two)), min(x[1], insert(two)), two, three]
    return v[0]


def test_against_dynamic_programming():
    rng = random.Random(1)
    for n in [*range(10)] * 150 + [200, 700]:
        kinds = tuple(C.Kind(rng.choice("suaua") if rng.random() < 0.9 else "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(n))
        assert C.audit(kinds) == dp(kinds)


def test_prices_are_dual_feasible_and_tight():
    """No arc is shorter than the fall of price along it, and every node has a tight one."""
    rng = random.Random(7)
    for _ in range(50):
        kinds = tuple(C.Kind(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 12)))
        price = C.prices(kinds)
        for i in range(len(kinds) + 1):
            for s in range(4):
                at = 4 * i + s
                ends = [(cost, at + 4 * on + to - s) for _, cost, on, to in C._arcs(kinds[i] if i < len(kinds) else None)[s]]
                ends += [(0, len(price) - 1)] if i == len(kinds) and s in (0, 3) else []
                assert all(price[at] <= cost + price[to] for cost, to in ends) and any(price[at] == cost + price[to] for cost, to in ends)


def plain(rows):
    """Repair of one conversation's (turn, role, text) after damage, from the rules."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    kinds = [C.Kind(r[:1] if r[:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults, strict=True)]
    cost, audit = dp(kinds)
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        before = out[-1][0] if out else "s"
        role = "assistant" if before.startswith("u") else "user"
        if letter == "K":
            role = rows[i][1]
        out.append((role, "" if letter == "I" else rows[i][2]))
        i += letter != "I"
    assert GOOD.fullmatch("".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(row):
    conv, turn, role, text = (" " if x is None else x for x in row)
    h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return [(row[1], "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows():
    rng = random.Random(9)
    rows = []
    for conv in [*range(400), None]:
        for turn in range(rng.choice([0, 1, 2, 4, 6, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Hi.", "ok", "Yes!", "", " \n", None, "a. \t", "é?", "🙂"])))
    return rows


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).extend(damage(r))
    return {c: plain(sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))) for c, v in by.items()}


def test_query_against_plain_function_and_sql(spark, tmp_path):
    rows = random_rows()
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    report = compare(queries.op13_conversation_repair(spark, str(tmp_path)), con, queries.oracle_sql()["op13_conversation_repair"])
    assert report["values_match"], report


def test_conversations_across_batches(spark):
    """A conversation longer than a batch, with the long text once, and one that only a dropped row names."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}." if i else "x" * 200_000 + "!", True) for i in range(2600)] + [(2, 0, "user", "Hi.", False), (3, 5, "user", "Hi", True)]
    out = {r["conv"]: r for r in C.repair_conversations(spark.createDataFrame(rows, "conv bigint, n bigint, who string, said string, there boolean").withColumns({"id": F.lit(1), "audit": F.lit(2)}),
                                                        "conv", "n", "who", "said", F.col("there")).collect()}
    assert out[1]["audit"] == "K" * 2600 and out[1]["cost"] == 0 and len(out[1]["repaired"]) == 2600
    assert (out[2]["audit"], out[2]["cost"], out[2]["repaired"]) == ("", 0, []) and (out[3]["audit"], out[3]["cost"]) == ("D", 4)


def test_empty_table(spark):
    assert C.repair_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


@pytest.mark.parametrize("turns, audit", [([("user", "Hi."), ("assistant", "Yes.")], "KK"), ([("user", "Hi.")], "KI"), ([("assistant", "Yes.")], "IK"), ([("user", "Hi."), ("user", "Hi.")], "KDI"),
                                          ([("system", "Be.")], "D"), ([("system", "Be."), ("user", "Hi."), ("assistant", "Yes.")], "KKK"), ([("user", " ")], "D"), ([("tool", "x.")], "D"), ([], "")])
def test_small_cases(turns, audit):
    assert C.repair([(i, *t) for i, t in enumerate(turns)])["audit"] == audit
