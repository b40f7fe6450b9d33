"""Record comparison: one-to-one matching, structured similarity, tags over tokens, titles by characters."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.similarity import ratio


def one_to_one(left: list[str], right: list[str], least: float = 0.5) -> list[tuple[str, str, float]]:
    """Greedy pairs by falling similarity, each string used once, at least ``least`` alike."""
    # ratio is at most 2 min(n, m) / (n + m), so lengths alone rule pairs out
    near = ((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if not a + b or 2 * min(len(a), len(b)) / (len(a) + len(b)) >= least)
    scored = ((ratio(left[i], right[j]), i, j) for i, j in near)
    pairs = sorted((x for x in scored if x[0] >= least), key=lambda x: (-x[0], x[1], x[2]))
    used_a, used_b, out = set(), set(), []
    for s, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.append((left[i], right[j], s))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("s", T.DoubleType())])))
def one_to_one_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"a": x, "b": y, "s": round(s, 6)} for x, y, s in one_to_one(list(p), list(q))] for p, q in zip(a, b)])


def best_match(a: list[str], b: list[str]) -> float:
    """Mean over a of the best similarity in b; two empty lists are equal."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return sum(max(ratio(x, y) for y in b) for x in a) / len(a)


def record_similarity(a: dict, b: dict) -> float:
    """0.2 title, 0.15 purposes (Jaccard), 0.35 products both ways, 0.15 channels one way, 0.15 programs (0.4 name, 0.6 id)."""
    x, y = set(a["purpose"]), set(b["purpose"])
    purpose = len(x & y) / len(x | y) if x | y else 1.0
    product = (best_match(a["product"], b["product"]) + best_match(b["product"], a["product"])) / 2
    program = 0.4 * ratio(a["pgm_nm"], b["pgm_nm"]) + 0.6 * (a["pgm_id"] == b["pgm_id"])
    return 0.2 * ratio(a["title"], b["title"]) + 0.15 * purpose + 0.35 * product + 0.15 * best_match(a["channel"], b["channel"]) + 0.15 * program


def drop_tags(tokens: list[tuple[str, str, int, int]], single: set[str], runs: list[tuple[str, ...]], text: str) -> str:
    """text with the tokens (form, tag, start, end) blanked whose tag, or run of tags, is excluded."""
    gone = {i for i, t in enumerate(tokens) if t[1] in single}
    for run in runs:
        for i in range(len(tokens) - len(run) + 1):
            if tuple(t[1] for t in tokens[i : i + len(run)]) == run:
                gone |= set(range(i, i + len(run)))
    chars = list(text)
    for i in gone:
        chars[tokens[i][2] : tokens[i][3]] = " " * (tokens[i][3] - tokens[i][2])
    return " ".join("".join(chars).split())


def tag_spans(tokens: list[tuple[str, str, int, int]], pattern: tuple[str, ...], text: str) -> list[str]:
    """Pieces of text whose tokens carry the tags of pattern, one after another."""
    return [text[tokens[i][2] : tokens[i + len(pattern) - 1][3]] for i in range(len(tokens) - len(pattern) + 1) if tuple(t[1] for t in tokens[i : i + len(pattern)]) == pattern]


def frequent_title(text: str) -> str:
    """The line whose characters are the most frequent in the whole text, per character; the first wins ties."""
    count = Counter(c for c in text.lower() if not c.isspace())
    lines = [x.strip() for x in text.split("\n") if len(x.strip()) > 5]
    if not lines:
        return text.strip()[:50]
    return max(lines, key=lambda x: sum(count[c] for c in x.lower()) / len(x))[:100]


@F.pandas_udf(T.StringType())
def frequent_title_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else frequent_title(x))
