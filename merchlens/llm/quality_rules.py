"""Quality rules: a threshold table compiled into one projection of built-in functions.

``RULES`` is data: (name, ratio, lower bound, upper bound). ``quality_rules``
computes the counts of a text once, compiles every rule into a comparison on
them, and adds the verdicts. No user functions, no joins, no shuffle.

A null text has no words. Rows keep their order and number; repeated rows are
judged alike; extra columns pass through (a column of the input that has the
name of an output column is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.llm.shared import unused

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Frequent function words of the four languages of the test tables.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "was", "be", "with", "as", "this", "by", "at", "are", "from",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "des", "auf", "ein", "eine", "nicht", "sich",
    "le", "la", "les", "et", "un", "une", "du", "que", "qui", "dans", "est", "en", "pour", "sur", "avec", "au",
    "el", "los", "las", "y", "de", "por", "con", "del", "se", "lo", "para", "no", "es",
]

# A rule holds if lower <= ratio <= upper (None: no bound). Ratios are exact comparisons
# numerator * 1 >= bound * denominator, so an empty text divides by nothing.
RULES: list[tuple[str, str, str, float | None, float | None]] = [
    ("length", "n_words", "one", 50, 200_000),
    ("mean_word", "word_chars", "n_words", 2, 14),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("stop_words", "n_stop_words", "n_words", 0.04, None),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.3),
    ("repeats", "n_repeat_words", "n_words", None, 0.3),
]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``words``."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def repeated(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            hit = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(hit, lambda x: x["i"]))
            # Each marked window adds the words that the window before it in the text hasn't added.
            return F.transform(F.array(at), lambda a: F.aggregate(
                F.transform(a, lambda x, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), x - F.get(a, j - 1)))),
                F.lit(0).cast("bigint"), lambda t, x: t + x))[0]

        return F.transform(F.array(ordered), marked)[0]

    def count(w: Column) -> Column:
        def of(h: Column) -> Column:  # most texts repeat nothing: a sort of plain longs tells
            one = F.transform(F.array(F.array_sort(h)), lambda s: F.exists(
                F.sequence(F.lit(0), F.size(s) - 2), lambda j: F.get(s, j) == F.get(s, j + 1)))[0]
            return F.when((F.size(h) > 1) & one, repeated(h)).otherwise(F.lit(0).cast("bigint"))
        return F.when(F.size(w) >= 4, F.transform(F.array(windows(w)), of)[0]).otherwise(F.lit(0).cast("bigint"))

    return count(words)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct; inner arrays are bound once as lambda variables."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    line_counts = F.transform(F.array(lines), lambda x: F.struct(
        F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))[0]
    return F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(text, SYMBOL, -1)) - 1).cast("bigint").alias("n_symbols"),
        line_counts["dup"].alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        line_counts["n"].alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?"))).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.lit(1).cast("bigint").alias("one")))[0]


def compile_rules(counts: Column, rules=RULES) -> dict[str, Column]:
    """One boolean column per row of the threshold table."""
    out = {}
    for name, top, under, low, high in rules:
        a, b = counts[top].cast("double"), counts[under].cast("double")
        held = F.lit(True)
        if low is not None:
            held = held & (a >= F.lit(float(low)) * b)
        if high is not None:
            held = held & (a <= F.lit(float(high)) * b)
        out[name] = held
    return out


def quality_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add the counts, ``base_failed``, the names of the rules that fail (``failed_rules``) and ``kept``."""
    name = unused(df, "_q")
    counted = df.withColumn(name, _counts(F.coalesce(F.col(text), F.lit(""))))
    q = F.col(name)
    verdicts = compile_rules(q, rules)
    base_failed = (q["n_words"] < 50) | (F.lit(100) * q["n_repeat_words"] > F.lit(50) * q["n_words"])
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in verdicts.items()]), lambda x: x.isNotNull())
    kept = ~base_failed
    for ok in verdicts.values():
        kept = kept & ok
    out = {n: q[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")}
    return counted.withColumns({**out, "base_failed": base_failed, "failed_rules": failed, "kept": kept}).drop(name)
