"""Quality rules as a short-circuit cascade, in DataFrame functions only.

On a bounded hash sample the driver times each rule, with the measures that it needs,
and takes again and again the rule that rejects most per second of the rows which
the rules before it let pass. One CASE expression has them in that order; Spark
evaluates a branch only where all branches before it let the row pass. The order
changes the cost and which rule is named first, never the verdict. The measures of the
base verdict are part of the result and so are worked out for every row.

Defined cases: null text is the empty text and has no words; an empty table gives
no rows; a rule that gives null rejects nothing; repeated rows are judged each for
itself; other columns of the input pass through untouched unless a measure has
the same name, in which case the measure replaces them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name

#: Rows of the sample that orders the rules; has no influence on any verdict.
SAMPLE_ROWS = 512
#: Symbols counted by n_symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where ``reject`` is true. ``bill`` is the same without measures that the rule doesn't need, to time it by."""

    name: str
    reject: Column
    bill: Column | None = None


def words_of(text: Column) -> Column:
    """The words of text; tabs and line ends count as spaces."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the same text.

    Windows are compared by 64-bit hash. Where all are distinct the count is zero at
    once; else the (hash, place) pairs are sorted, so equal windows become neighbours.
    """
    n = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), n - (size - 1)), lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, size)]))

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def pick(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            at = F.transform(again, lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda x: F.sequence(x, x + (size - 1))))))

        return let(pairs, pick)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h))

    return F.when(n < size, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: it becomes the variable of a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    # one pass over the words: a lambda variable is evaluated once, a column may be inlined many times
    words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("r")))
    held = free_name(docs, "words")
    measured = docs.withColumn(held, words).withColumns(
        {
            "n_words": F.col(f"{held}.n"),
            "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col(f"{held}.r"),
        }
    )
    return measured.drop(held)


def base_rules(text: str = "text") -> list[Rule]:
    """The rules of the base verdict, over the measures."""
    return [
        Rule("short", F.col("n_words") < 50, F.size(words_of(F.coalesce(F.col(text).cast("string"), F.lit("")))) < 50),
        Rule("repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ]


def text_rules(text: str = "text") -> list[Rule]:
    """Further rules; each looks at the measures or at the text itself."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("dup_lines", (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * (1 + F.length(t) - F.length(F.translate(t, "\n", ""))))),
        Rule("capitals", 2 * F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")) > letters),
        Rule("letters", 2 * letters < F.col("word_chars")),
        Rule("shouting", 5 * (F.length(t) - F.length(F.translate(t, "!", ""))) > F.col("n_words")),
    ]


def sample_of(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The texts of at most ``rows`` rows, chosen by a hash of their number among all rows of docs.

    A threshold on the hash, from the number of rows, leaves about twice as many rows in all
    tasks together, so the least of them can be sent to one.
    """
    h = free_name(docs, "h")
    share = min(1.0, 2 * rows / max(1, docs.count()))
    near = docs.select(text, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)).alias(h)).filter(F.col(h) < int(share * (1 << 40)))
    return near.orderBy(h).limit(rows).drop(h)


def greedy_order(rules: list[Rule], seconds: list[float], rejects: list[list[bool]]) -> list[Rule]:
    """Always the rule that rejects most per second of the rows which the rules before it let pass; the name breaks ties.

    rejects holds a list for each sampled row, with an entry for each rule.
    """
    left, rows, out = list(range(len(rules))), rejects, []
    while left:
        rate = {i: sum(r[i] for r in rows) / seconds[i] for i in left}
        best = min(left, key=lambda i: (-rate[i], rules[i].name))
        out.append(rules[best])
        left.remove(best)
        rows = [r for r in rows if not r[best]]
    return out


def order_rules(sample: DataFrame, rules: list[Rule], text: str = "text", repeats: int = 2) -> list[Rule]:
    """The order of the cascade, from each rule's time and rejections on the sample.

    Only the sample's text is cached, so a rule's time holds the measures that it needs
    itself; the least of some runs counts, less the time of a job that evaluates nothing.
    """
    sample = sample.select(text).cache()
    try:
        if not rules or not sample.count():
            return list(rules)
        measured = with_measures(sample, text)

        def seconds(c: Column) -> float:
            took = []
            for _ in range(repeats):
                began = time.perf_counter()
                measured.agg(F.count(F.when(c, 1))).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        empty = seconds(F.lit(False))
        cost = [max(seconds(rule.reject if rule.bill is None else rule.bill) - empty, 1e-3) for rule in rules]
        # SAMPLE_ROWS rows of one flag a rule
        flags = measured.select(*[F.coalesce(rule.reject, F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]).collect()
        return greedy_order(rules, cost, [list(r) for r in flags])
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the row, or null."""
    out = F
    for rule in rules:
        out = out.when(rule.reject, F.lit(rule.name))
    return out.otherwise(F.lit(None)) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, base: list[Rule] | None = None, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the measures, base_failed, rejected_by and kept."""
    base = base_rules(text) if base is None else base
    rules = text_rules(text) if rules is None else rules
    measured = with_measures(docs, text)
    ordered = order_rules(sample_of(docs, text), [*base, *rules], text)
    failed = F.lit(False)
    for rule in base:
        failed = failed | F.coalesce(rule.reject, F.lit(False))
    judged = measured.withColumn("rejected_by", cascade(ordered)).withColumn("base_failed", failed)
    return judged.withColumn("kept", F.col("rejected_by").isNull())
