"""Quality rules as a short-circuit cascade (operator 7).

Every document gets its measures (``measures``), which the result shows.  The
rules are conditions on measures and on what they compute from the row's words
themselves.  On a sample of rows, chosen by a hash of the id, the cascade
estimates for each rule the share of rows that it rejects (selectivity) and its
work (cost: characters, words or lines touched, times the rule's weight), and
picks one rule after the other: the one with most rejections per cost among the
rows that the earlier ones leave.  The ordered rules become one ``CASE WHEN``:
Spark evaluates a branch, and what is computed inside it, only for rows that no
earlier rule has rejected, and the branch that fires names the rejecting rule.
The verdict is the conjunction of all rules, so the sample decides about speed
only.

Defined cases: a null text has no words and fails the base rule; empty and
white-space texts likewise.  Measures are per row, so repeated rows get equal
verdicts.  An empty table gives an empty result (rules in declared order).
Windows of words are compared by 64-bit hashes of their eight words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import WHITE, WORD, text_or_empty, training_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL condition on measures and on ``words``, the row's words (null counts as false); the cost of
    one evaluation is ``weight`` times the row's ``unit`` (n_chars, n_words, n_lines, or 1)."""

    name: str
    rejects: str
    unit: str = "1"
    weight: float = 1.0


#: 20 words at least, and at most 30 % of the words in repeated windows.
BASE = (
    Rule("few_words", "n_words < 20", "n_words", 2.0),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words", "n_words", 20.0),
)
#: Limits far outside prose, so that clean documents pass.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", "n_chars", 1.0),
    Rule("symbols", "10 * n_symbols > 3 * n_words", "n_chars", 1.0),
    Rule("repeated_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines", "n_lines", 8.0),
    Rule("few_letters", r"2 * size(filter(words, w -> w rlike '\\p{L}')) < n_words", "n_words", 4.0),
)
SAMPLE_ROWS = 2_000


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, words)."""
    df = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    text = F.col("text")
    df = df.withColumns({
        "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
    })
    df = df.select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    return _repeated_words(df).drop("codes")


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words covered by windows of ``codes`` that occur twice or more in the row.

    Only rows with a repeated window sort their windows; neighbours that are
    equal after the sort give the positions, in n log n for texts of any length.
    """
    kept = [c for c in df.columns]
    windows = F.transform(F.sequence(F.lit(0), F.size("codes") - WINDOW), lambda i: F.xxhash64(
        *[F.get("codes", i + k) for k in range(WINDOW)]))
    df = df.withColumn("wins", F.when(F.size("codes") >= WINDOW, windows))
    in_order = F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("pairs", F.when(F.size(F.array_distinct("wins")) < F.size("wins"), in_order)).drop("wins")
    twice = F.filter("pairs", lambda x, k: (x["h"] == F.get("pairs", k - 1)["h"])
                     | (x["h"] == F.get("pairs", k + 1)["h"]))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("pairs")
    gaps = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return df.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
                  rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules as (rule, share rejected, cost), each the best by rejections per cost among the rows that those before
    it leave.  Only about ``rows`` rows, chosen by a hash of the id, are measured; their flags and sizes come here."""
    sample = measures(training_sample(docs, id_col, rows, "quality"), id_col, text_col)
    flags = [F.expr(f"coalesce(cast(({r.rejects}) as int), 0)").alias(f"r{i}") for i, r in enumerate(rules)]
    units = [F.expr(f"cast({r.unit} as double)").alias(f"u{i}") for i, r in enumerate(rules)]
    return _picked(list(rules), sample.select(*flags, *units).limit(4 * rows).collect())


def _picked(rules: list[Rule], sample: list) -> list[tuple[Rule, float, float]]:
    left, open_rules, out = sample, list(range(len(rules))), []
    while open_rules:
        n = max(1, len(left))

        def rated(i: int, left=left, n=n) -> tuple[float, float]:
            return sum(x[f"r{i}"] for x in left) / n, max(1e-9, rules[i].weight * sum(x[f"u{i}"] for x in left) / n)

        best = max(open_rules, key=lambda i: (rated(i)[0] / rated(i)[1], -i))
        out.append((rules[best], *rated(best)))
        open_rules.remove(best)
        left = [x for x in left if not x[f"r{best}"]]
    return out


def first_rejection(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the row, null if none does."""
    chain = F
    for r in rules:
        chain = chain.when(F.expr(r.rejects), F.lit(r.name))
    return chain if rules else F.lit(None).cast("string")


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Rule] = BASE,
                    rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measures of every row, ``base_failed``, ``rejected_by`` (of ``rules``, for rows that pass the base) and
    ``kept``."""
    ordered = [r for r, _, _ in cascade_order(docs, rules, id_col, text_col)]
    out = measures(docs, id_col, text_col).withColumn("base_failed", first_rejection(base).isNotNull())
    out = out.withColumn("rejected_by", F.when(~F.col("base_failed"), first_rejection(ordered))).drop("words")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
