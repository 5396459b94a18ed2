import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from merchlens.llm import pii as P
from merchlens.llm import queries

LUHN = "4111111111111111"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def brute_base(text):
    """The base kinds by the contract's patterns and Python's own search."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def kinds(text):
    return [(x.kind, text[x.start:x.end]) for x in P.find_pii(text)]


def test_base_is_what_the_patterns_find():
    rng = random.Random(11)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "a@b", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "001.002.03.4", LUHN, "4111 1111 1111 1111", "4111-1111", "+1 (743) 555-3824",
             "+1", "+((", "(", ")", "-", " ", "  ", "\n", "é", "🙂", "7", "12", "_d@e.f", "00", "card", "phone", "99999999999999999999"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        found = [x for x in P.find_pii(text) if x.base]
        assert [(x.kind, x.start, x.end) for x in found] == brute_base(text), text
        assert all(P.ACCEPT <= x.score <= 110 for x in found)


def test_checksums():
    assert P.luhn(LUHN) and not P.luhn("4111111111111112")
    assert all(P.luhn(str(n)) == luhn(str(n)) for n in range(3000))
    assert P.mod97("GB82 WEST 1234 5698 7654 32") and P.mod97("DE89370400440532013000") and not P.mod97("DE89370400440532013001")
    assert P.octets("255.0.0.1") and P.octets("000255.0.0.1") and not P.octets("256.0.0.1") and not P.octets("1.2.3." + "9" * 5000)


def test_method_adds_spans():
    assert ("card", LUHN) in kinds(f"see 7536784127813050 {LUHN} here")  # the base pattern takes both numbers as one and drops it
    assert kinds(f"x {LUHN}9 y") == [] and kinds(f"a{LUHN[:15]} b") == []
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("pay GB82 WEST 1234 5698 7654 32.") and kinds("pay GB83 WEST 1234 5698 7654 32.") == []
    assert ("phone", "+1 (743) 555-3824") in kinds("+1 (743) 555-3824 980791576280")
    assert ("phone", "743-555-3824") in kinds("call 743-555-3824 now") and kinds("sum 743-555-3824 now") == []
    assert ("ssn", "123-45-6789") in kinds("SSN: 123-45-6789") and kinds("SSN: 666-45-6789") == kinds("no. 123-45-6789") == []


def test_context_adjusts_the_score():
    short = "378282246310005"  # 15 digits: needs a word that speaks for it
    assert kinds(f"n {short} x") == [] and kinds(f"amex {short} x") == [("card", short)] and kinds(f"amex order {short} x") == []
    near, far = f"card {'x' * 30} {short}", f"card {'x' * 40} {short}"
    assert kinds(near) and not kinds(far)
    base = P.find_pii(f"order {LUHN}")
    assert [(x.kind, x.score, x.base) for x in base] == [("card", 50, True)]
    assert P.find_pii(f"card {LUHN}")[0].score > P.find_pii(f"cart {LUHN}")[0].score > base[0].score


def test_extra_spans_give_way():
    for text in (f"card {LUHN}", "phone +1 743 555 3824", "card 4111 1111 1111 1111"):
        found = P.find_pii(text)
        assert len(found) == 1 and found[0].base


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1((" * 75_000, "a." * 150_000 + "@", "@a" * 150_000, "A1 " * 100_000, "+" + "1 (" * 100_000):
        P.find_pii(text)


def test_operator_keeps_rows_and_columns(spark, odd, none):
    out = P.personal_data(odd.withColumn("pii", F.lit(3)).withColumn("c0", F.lit(4)))
    assert sorted(out.columns) == sorted([*odd.columns, "pii", "c0"]) and out.count() == odd.count()
    assert P.personal_data(none).collect() == []
    for r in out.collect():
        assert [(x["kind"], x["start"], x["end"]) for x in r["pii"] if x["base"]] == brute_base(r["text"])


def test_query(spark, texts, tmp_path):
    sf = "/root/testdata/sf0.001"
    for r in queries.op11_pii(spark, sf).collect():
        found = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(f[0] == k for f in found) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in found} <= set(r["spans"].split(","))


def test_oracle_agrees_on_odd_texts(spark, tmp_path):
    rng = random.Random(5)
    parts = ["a@b.co ", "1.2.3.4 ", "300.2.3.4 ", "1.2.3.4.5 ", f"{LUHN} ", f"7536784127813050 {LUHN} ", "378282246310005 ", "card ", "amex ", "order ", "call ", "tel ", "743-555-3824 ", "(743) 555-3824 ", "+1 743 555 3824 99 ",
             "+1 (743) 555-3824 ", "+49 30 1234567 ", "SSN ", "123-45-6789 ", "GB82 WEST 1234 5698 7654 32 ", "DE89370400440532013000 ", "bank ", "serial ", "é", "🙂 ", "TÉL ", "téléphone ", "x", "\n", "4111 1111 1111 1111 ", "4111-1111-1111-1111-12 "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(1500)] + [(1500, None), (1501, "")]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    report = compare(queries.op11_pii(spark, folder), con, queries.oracle_sql()["op11_pii"])
    assert report["values_match"], report


@pytest.mark.parametrize("kind", P.KINDS)
def test_every_kind_has_words(kind):
    assert set(P.FOR[kind]).isdisjoint(P.AGAINST[kind]) and kind in {r.kind for r in P.RECOGNISERS}
