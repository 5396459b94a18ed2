"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm import chat_format as chat
from merchlens.llm import conversation_repair, periodic_runs, pii
from merchlens.llm import jaccard_join as jaccard
from merchlens.llm import kneser_ney
from merchlens.llm import language_crf as language
from merchlens.llm import quality_rules as quality
from merchlens.llm import sentencepiece_bpe as pieces
from merchlens.llm import sharding, toxicity, warc_bundles, winnowing
from merchlens.llm.shared import documents


def remainder(id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % of


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard.jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out third."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs, usable=remainder("doc_id", 3) != 1)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    index = warc_bundles.write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    read = warc_bundles.read_bundles(index, with_payload=False)
    return read.select(F.when(F.col("record") != "null", F.col("record")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"))


_OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first, count(*) AS copies FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN copies > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copies > 1 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op4_sql() -> str:
    stop = ", ".join(f"'{x}'" for x in quality.STOP_WORDS)
    held = []
    for _, top, under, low, high in quality.RULES:
        held += [f"{top}::DOUBLE >= {float(low)!r}::DOUBLE * {under}::DOUBLE"] if low is not None else []
        held += [f"{top}::DOUBLE <= {float(high)!r}::DOUBLE * {under}::DOUBLE"] if high is not None else []
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, [word, lead(word, 1) OVER q, lead(word, 2) OVER q] AS g, lead(i, 2) OVER q AS last FROM p WINDOW q AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE last IS NOT NULL) WHERE n > 1),
m AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, 1 AS one,
        len(list_filter(w, lambda x: lower(trim(x, '.,;:!?')) IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN m USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(held)} AS kept FROM b
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes; equal texts are neighbours in the key order."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        F.xxhash64("text").alias("text_hash"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard_rows(rows, ["text_hash", "doc_id"], "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.format_chats(rows.unionByName(probe))
    read = made.select("conv_id", "formatted", "valid", "bad_turn", chat.read_turns(F.col("formatted")).alias("turns"),
                       F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", F.col("bad_turn").cast("bigint").alias("bad_turn"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out quarter."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=remainder("id", 4) != 2)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of the training four fifths, and the unigram base."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)))
    out = kneser_ney.score(docs, kneser_ney.fit(docs.where(~F.col("held_out"))))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    out = winnowing.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again: token count, hash of the ids, digest of the decoded text."""
    made = pieces.decode(pieces.encode(documents(spark, sf_dir).select("doc_id", "text")))
    return made.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_tokens"), F.xxhash64("piece_ids").alias("ids_hash"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans counted and hashed, all spans listed."""
    found = pii.personal_data(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda x: x["base"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")

    counts = [number(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def _op11_sql() -> str:
    """Matches and gaps between them give positions; checks and nearby words as in the rules, written anew."""
    near = {"email": ("email mail contact", ""), "ip": ("ip host server address", "version release"),
            "card": ("card credit visa mastercard amex karte kreditkarte carte tarjeta", "order invoice isbn serial tracking"),
            "phone": ("phone tel telephone mobile call fax telefon anrufen téléphone teléfono", "order invoice isbn serial tracking"),
            "iban": ("iban account bank konto compte cuenta", "serial tracking"), "ssn": ("ssn social security", "order invoice part serial tracking")}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, len({digits}) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN ascii({digits}[-i]) - 48
        ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][ascii({digits}[-i]) - 47] END)::BIGINT)) % 10 = 0"""
    account = "replace(m, ' ', '')"
    mod97 = f"""list_reduce(list_concat([0::BIGINT], list_transform(string_split({account}[5:] || {account}[1:4], ''), lambda c: (CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT)),
        lambda v, d: (v * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"""
    between = f"len({digits}) BETWEEN"
    rules = [  # order, kind, pattern, condition, prior, base
        (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 70, True),
        (0, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(right('000' || ltrim(x, '0'), greatest(3, len(ltrim(x, '0')))) AS HUGEINT), 256))) <= 255", 60, True),
        (0, "card", r"[0-9]([\x20-]?[0-9])+", f"{between} 16 AND 19 AND {luhn}", 80, True),
        (0, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{between} 8 AND 15", 60, True),
        (1, "iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", f"len({account}) BETWEEN 15 AND 34 AND {mod97}", 80, False),
        (2, "card", "[0-9]+", f"{between} 16 AND 19 AND {luhn}", 50, False),
        (3, "card", r"[0-9]{4}([\x20-][0-9]{4}){3}", luhn, 50, False),
        (4, "card", "[0-9]+", f"{between} 13 AND 15 AND {luhn}", 30, False),
        (5, "phone", r"\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}", "true", 50, False),
        (6, "phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "true", 30, False),
        (7, "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'", 30, False)]
    order = {k: i for i, k in enumerate(("email", "ip", "card", "phone", "iban", "ssn"))}

    def words(of: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in of.split()) + "]::VARCHAR[]"

    found = []
    for rank, kind, pattern, check, prior, base in rules:
        edge = "true" if base else "NOT regexp_matches(before[-1:], '[A-Za-z0-9]') AND NOT regexp_matches(after[1:1], '[A-Za-z0-9]')"
        score = f"{prior} + 30 * list_has_any(near, {words(near[kind][0])})::INT - 30 * list_has_any(near, {words(near[kind][1])})::INT"
        found.append(rf"""
SELECT r, {rank} AS rank, {order[kind]} AS place, '{kind}' AS kind, s AS start, s + len(m) AS stop, {base} AS base,
       {'100' if base else score} AS score
FROM (SELECT *, regexp_extract_all(lower_ascii(before || ' ' || after), '[a-z\x{{80}}-\x{{10FFFF}}]+') AS near FROM
      (SELECT *, text[greatest(1, s - 39):s] AS before, text[s + len(m) + 1:s + len(m) + 40] AS after FROM
       (SELECT r, text, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: (list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT)) AS s
        FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM t))))
WHERE {check} AND {edge}""")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = " UNION ALL ".join(found).replace("lower_ascii(before || ' ' || after)", lower.format("before || ' ' || after"))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT * FROM ({parts}) WHERE score >= 50),
k AS (SELECT * FROM f AS x WHERE base OR NOT EXISTS (FROM f AS y WHERE y.r = x.r AND y.rank < x.rank AND y.start < x.stop AND x.start < y.stop)),
g AS (SELECT r, count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip, count(*) FILTER (base AND kind = 'card') AS n_card,
             count(*) FILTER (base AND kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start, stop) FILTER (base) AS b,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start, stop) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (r)
"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document (by the crc32 of its id) with a periodic tail: words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.withColumns({"w": F.when(h % 10 == 0, words), "g": F.floor(h / 10)}).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    tail = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return chosen.withColumn("text", F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, F.array_join(tail, " ")).otherwise(F.col("text"))).drop("w", "g", "n")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, the strongest one, and the collapsed text."""
    found = periodic_runs.periodic_runs(planted_periods(documents(spark, sf_dir).select("doc_id", "text"))).drop("text")

    def stronger(x: Column, y: Column) -> Column:
        one, other = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(one > other, -1).when(one < other, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))

    best = F.get(F.array_sort("runs", stronger), 0)
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after damage; a dropped row stays as one whose ``present`` is false."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    h = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"]).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(filled["text"], ".!?", "")).otherwise(filled["text"])
    present = F.when(h == 0, F.array(F.lit(False))).when(h == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(filled["role"]).alias("role"), text.alias("text"), F.explode(present).alias("present"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    made = conversation_repair.repair_conversations(rows, present=F.col("present"))
    whole = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(whole.cast("binary"), 256).alias("repaired_sha256"))


def _op13_sql() -> str:
    """The lattice from its last column to the first: (cost, audit) of each state by recursion."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
        list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

    def step(v: str, letter: str, cost: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {v}.c + {cost}, 'a': '{letter}' || {v}.a}} END"

    def least(*of: str) -> str:
        return f"list_sort([{', '.join(of)}], 'ASC', 'NULLS LAST')[1]"

    def turn(s: int) -> str:
        to = 4 if s == 3 else 3  # states are numbered from 1: start, system, user, assistant
        keeps = [step(f"v[{to}]", "K", "t", f"NOT gone AND z = '{'a' if s == 3 else 'u'}'")] + ([step("v[2]", "K", "t", "NOT gone AND z = 's'")] if s == 1 else [])
        return least(step(f"v[{s}]", "D", "4"), step(f"v[{to}]", "R", "3 + t", "NOT gone"), *keeps)

    return rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM h, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, left(role, 1) AS z, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
k AS (SELECT conv_id, i, role, text, z, blank OR again AS gone, blank, again, pair, NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM f),
q AS (SELECT conv_id, i, z, gone, CASE WHEN cut THEN 3 ELSE 0 END AS t FROM k),
s(conv_id, i, v) AS (
  SELECT conv_id, max(i), [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM k GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [{least('w[1]', step('w[3]', 'I', '3'))}, {least('w[2]', step('w[3]', 'I', '3'))}, w[3], w[4]] FROM
    (SELECT conv_id, i, [x[1], x[2], {least('x[3]', step('x[4]', 'I', '3'))}, {least('x[4]', step('x[3]', 'I', '3'))}] AS w FROM
      (SELECT s.conv_id, s.i - 1 AS i, [{', '.join(turn(n) for n in (1, 2, 3, 4))}] AS x FROM s JOIN q ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.i = s.i))),
e AS (SELECT conv_id, v[1].c::BIGINT AS cost, v[1].a AS audit FROM s WHERE i = 0),
l AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS j, unnest(string_split(audit, '')) AS l FROM e WHERE audit <> ''),
m AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS out FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
n AS (SELECT m.conv_id, j, l, out, role, text, max(CASE WHEN out = 1 AND l = 'K' AND z = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS system
      FROM m LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM m.conv_id AND k.i = m.i AND l <> 'I' WHERE l <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole FROM n GROUP BY conv_id),
c AS (SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM d GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
"""


_OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, string_agg(s, ',' ORDER BY s) AS ids, count(*) AS n_items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


# Lengths of what the template puts around a text, and the turn order as regular expressions over the roles' letters.
_OP6_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '[\[<]\\*(?:/?(?:SYS|INST|BOT|TOOL|ROLE|TEXT)\]|/?s>)')) AS escapes,
             len(regexp_extract_all(role, '[\[<]\\*(?:/?(?:SYS|INST|BOT|TOOL|ROLE|TEXT)\]|/?s>)')) AS role_escapes,
             CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END AS letter FROM r),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text) AS letters,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (letter = 'a'), 0)::BIGINT AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (letter = 'a'), '')) AS loss_sha256,
             (3 + sum(length(text) + escapes + CASE letter WHEN 's' THEN 13 WHEN 'u' THEN 15 WHEN 'a' THEN 11 WHEN 't' THEN 15 ELSE 21 + length(role) + role_escapes END))::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, regexp_full_match(letters, 's?ua(?:ua|ta)*') AS valid,
       nullif(length(regexp_extract(letters, '^s?(?:u(?:a(?:ua|ta)*[ut]?)?)?')), n_turns) AS bad_turn
FROM c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_crf": op2_language_crf,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_chat_format": op6_chat_format,
    "op7_toxicity": op7_toxicity,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_winnowing": op9_winnowing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_bundles": _OP3_SQL, "op4_quality_rules": _op4_sql(), "op6_chat_format": _OP6_SQL, "op9_winnowing": _OP9_SQL,
            "op11_pii": _op11_sql(), "op13_conversation_repair": _op13_sql()}
