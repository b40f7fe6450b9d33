"""Alias rules: building, swapping and cascading expansion of item names."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast at most; more raise.
MAX_RULES = 200_000


def explode_rules(rules: DataFrame) -> DataFrame:
    """Rules with alternatives split at '&&'; missing case marks are S."""
    one = rules.withColumn("alias_1", F.explode(F.split("alias_1", "&&"))).withColumn("alias_2", F.explode(F.split("alias_2", "&&")))
    return one.fillna("S", ["case_1", "case_2"])


def both_ways(rules: DataFrame) -> DataFrame:
    """rules and, for direction B, the same with their sides swapped."""
    back = rules.filter("direction = 'B'").withColumns({"alias_1": F.col("alias_2"), "alias_2": F.col("alias_1"), "case_1": F.col("case_2"), "case_2": F.col("case_1")})
    return rules.unionByName(back).dropDuplicates()


def build_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(alias_1, alias_2): for 'build' rules, items of the rule's category whose name holds the alias as a word."""
    build = rules.filter("type = 'build'").select("alias_1", F.col("category").alias("domain"))
    found = items.join(F.broadcast(build), "domain").filter(F.contains(F.col("item_nm"), F.col("alias_1")))
    return found.select("alias_1", F.col("item_nm").alias("alias_2")).distinct()


def expand(name: str, rules: list[tuple], depth: int = 7) -> list[str]:
    """All names that rules (from, to, type, case) reach from name, breadth first, name itself first.

    A rule serves once on a path. Exact rules replace the whole string; others all
    occurrences (case S) or the first one regardless of case (case I).
    """
    found, seen, queue = {name: None}, set(), deque([(name, 0, frozenset())])
    while queue:
        now, at, used = queue.popleft()
        if at >= depth or now in seen:
            continue
        seen.add(now)
        for k, (source, target, kind, case) in enumerate(rules):
            if k in used:
                continue
            if kind == "exact":
                hit = now == source if case == "S" else now.lower() == source.lower()
                new = target if hit else None
            elif case == "S":
                new = now.replace(source, target) if source in now else None
            else:
                i = now.lower().find(source.lower())
                new = now[:i] + target + now[i + len(source) :] if i >= 0 else None
            if new and new not in found:
                found[new] = None
                queue.append((new, at + 1, used | {k}))
    return list(found)


def cascade(items: DataFrame, rules: DataFrame, depth: int = 7) -> DataFrame:
    """items with one row per name reachable by the rules, in column item_nm_alias; rules are a checked small table."""
    rows = [(r["alias_1"], r["alias_2"], r["type"], r["case_1"]) for r in rules.orderBy("alias_1", "alias_2", "type").limit(MAX_RULES + 1).collect()]
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} alias rules")
    sent = items.sparkSession.sparkContext.broadcast(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["item_nm_alias"] = pdf["item_nm"].map(lambda x: expand(x, sent.value, depth))
            yield pdf.explode("item_nm_alias")

    schema = ", ".join(f"{n} {k}" for n, k in items.dtypes) + ", item_nm_alias string"
    return items.mapInPandas(run, schema).dropDuplicates()
