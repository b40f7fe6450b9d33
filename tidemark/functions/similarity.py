"""String similarities: column expressions where Spark has the parts, Arrow functions where it has not."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (one integer a row)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (n + m): the normalised insert-delete similarity; two empty strings are equal."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string to any window of its length in the longer one."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 1.0 if not b else 0.0
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 1.0
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def fuzzy(a: str, b: str) -> float:
    return max(ratio(a, b), partial_ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))


def weighted(a: str, b: str) -> float:
    """0.3 ratio, 0.1 best window scaled by the lengths, 0.2 shared words, 0.2 sorted and 0.2 set words; equal strings give 1."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    x, y = set(a.split()), set(b.split())
    shared = len(x & y) / len(x | y) if x | y else 0.0
    return 0.3 * ratio(a, b) + 0.1 * partial_ratio(a, b) * (short / long if long else 0.0) + 0.2 * shared + 0.2 * token_sort_ratio(a, b) + 0.2 * token_set_ratio(a, b)


def wide_ratio(a: str, b: str) -> float:
    """The best of ratio, word-wise ratios at 0.95, and for unlike lengths (half as long again or more) the best window at 0.9, beyond eight times at 0.6."""
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    words = 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if unlike < 1.5:
        return max(ratio(a, b), words)
    return max(ratio(a, b), partial_ratio(a, b) * (0.9 if unlike <= 8 else 0.6), words * 0.9)


def sequence_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over both lengths."""
    return difflib.SequenceMatcher(None, a, b, False).ratio()


def longest_common_run(a: str, b: str) -> int:
    """Length of the longest common substring."""
    return difflib.SequenceMatcher(None, a, b, False).find_longest_match().size if a and b else 0


def best_gram_window(a: str, b: str, n: int = 2) -> float:
    """Best Jaccard of n-grams of the shorter string and any window of its length in the longer one."""
    a, b = sorted((a, b), key=len)
    grams = lambda s: {s[i : i + n] for i in range(len(s) - n + 1)} or {s}
    if not a:
        return 1.0 if not b else 0.0
    x = grams(a)
    return max(len(x & y) / len(x | y) for y in (grams(b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)))


def character_similarity(a: str, b: str) -> float:
    """The mean of the best window, the longest common run and subsequence over the longer length, and the matching blocks' ratio."""
    a, b = a.lower(), b.lower()
    size = max(len(a), len(b))
    if not size:
        return 1.0
    return (best_gram_window(a, b) + longest_common_run(a, b) / size + lcs_length(a, b) / size + block_ratio(a, b)) / 4


_NORM: dict[str, Callable[[int, int], int]] = {"max": max, "min": min, "s1": lambda n, m: n, "s2": lambda n, m: m}


def lcs_ratio(a: str, b: str, norm: str = "max") -> float:
    size = _NORM[norm](len(a), len(b))
    return lcs_length(a, b) / size if size else 0.0


def block_ratio(a: str, b: str, norm: str = "max") -> float:
    """Characters in matching blocks over the normalising length."""
    size = _NORM[norm](len(a), len(b))
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()) / size if size else 0.0


def substring_aware(a: str, b: str, norm: str = "max") -> float:
    short, long = sorted((a, b), key=len)
    if short and short in long:
        return min(0.95 + 0.05 * len(short) / len(long), 1.0)
    return lcs_ratio(a, b, norm)


def token_ratio(a: str, b: str, norm: str = "max") -> float:
    """LCS over words cut at whitespace, _ and -."""
    x, y = (re.split(r"[\s_\-]+", s.strip()) if s.strip() else [] for s in (a, b))
    codes = {w: chr(0x10000 + i) for i, w in enumerate(dict.fromkeys([*x, *y]))}
    return lcs_ratio("".join(map(codes.__getitem__, x)), "".join(map(codes.__getitem__, y)), norm)


def combined(a: str, b: str, norm: str = "max") -> float:
    """0.1 substring-aware + 0.7 matching blocks + 0.2 words, on lower-cased strings."""
    a, b = a.lower(), b.lower()
    return 0.1 * substring_aware(a, b, norm) + 0.7 * block_ratio(a, b, norm) + 0.2 * token_ratio(a, b, norm)


def alignment(a: list[str], b: list[str]) -> float:
    """Needleman-Wunsch score of two word lists (match 1, mismatch and gap -1), scaled to 0..1."""
    if not a and not b:
        return 1.0
    row = [-j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [-i]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (1 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row = new
    size = max(len(a), len(b))
    return (row[-1] + size) / (2 * size)


#: Pairs whose tables of an alignment are worked out together.
ALIGNED = 256


def alignments(a: pa.Array, b: pa.Array) -> np.ndarray:
    """alignment() of two columns of word lists, nan where either is null.

    Cells of one anti-diagonal depend on the two before it only, so a diagonal of all the
    tables of a batch is one array operation. Pairs are batched by size.
    """
    words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cut = len(a.flatten())
    out = np.full(len(a), np.nan)
    sides = []
    for c, flat in ((a, words[:cut]), (b, words[cut:])):
        offsets = c.offsets.to_numpy() - c.offsets[0].as_py()
        sides.append((flat, offsets[:-1], np.diff(offsets)))
    live = np.flatnonzero(~(a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)))
    live = live[np.argsort(np.maximum(sides[0][2], sides[1][2])[live], kind="stable")]
    for k in range(0, len(live), ALIGNED):
        rows = live[k : k + ALIGNED]
        (x, n), (y, m) = ((np.full((len(rows), max(1, int(size[rows].max()))), fill, dtype=np.int64), size[rows]) for (_, _, size), fill in zip(sides, (-2, -3)))
        for table, (flat, start, size) in zip((x, y), sides):
            inside = np.arange(table.shape[1]) < size[rows][:, None]
            table[inside] = flat[(start[rows][:, None] + np.arange(table.shape[1]))[inside]]
        out[rows] = _diagonals(x, y, n, m)
    return out


def _diagonals(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    rows, width = len(x), x.shape[1] + 1
    before, last = np.zeros((rows, width)), np.zeros((rows, width))
    score = np.where((n == 0) & (m == 0), 0.0, np.nan)
    for d in range(1, x.shape[1] + y.shape[1] + 1):
        i = np.arange(max(0, d - y.shape[1]), min(d, x.shape[1]) + 1)
        now = np.full((rows, width), -np.inf)
        if i[0] == 0:
            now[:, 0] = -d
        if i[-1] == d:
            now[:, d] = -d
        k = i[(i > 0) & (i < d)]
        same = np.where(x[:, k - 1] == y[:, d - k - 1], 1.0, -1.0)
        now[:, k] = np.maximum(before[:, k - 1] + same, np.maximum(last[:, k - 1], last[:, k]) - 1)
        end = np.flatnonzero(n + m == d)
        score[end] = now[end, n[end]]
        before, last = last, now
    size = np.maximum(n, m)
    return np.where(size == 0, 1.0, (score + size) / np.maximum(2 * size, 1))


@F.arrow_udf(T.DoubleType())
def token_alignment(a: pa.Array, b: pa.Array) -> pa.Array:
    """Needleman-Wunsch score of two word lists, scaled to 0..1; null where either is null."""
    got = alignments(a, b)
    return pa.array(np.round(got, 9), mask=np.isnan(got))


def metric(f: Callable[..., float], *args):
    """A double pandas UDF of two string columns; null where either is null."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else round(f(x, y, *args), 9) for x, y in zip(a, b)], dtype="float64")

    return run


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / size)


def loosely_equal(a: Column, b: Column, least: float = 0.7) -> Column:
    """Equal, one inside the other, or word sets of Jaccard ``least`` and more, in lower case."""
    a, b = F.lower(a), F.lower(b)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    shared, every = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.contains(a, b) | F.contains(b, a) | ((every > 0) & (shared >= least * every))


def loose_hits(found: Column, gold: Column) -> Column:
    """How many entries of found meet an entry of gold loosely; each takes the first that is still free, in sorted order."""

    def take(left: Column, entry: Column) -> Column:
        at = F.array_position(F.transform(left, lambda g: loosely_equal(entry, g)), True).cast("int")
        rest = F.concat(F.slice(left, 1, at - 1), F.slice(left, at + 1, F.size(left)))
        return F.when(at > 0, rest).otherwise(left)

    gold = F.array_sort(F.array_distinct(gold))
    return F.size(gold) - F.size(F.aggregate(F.array_sort(F.array_distinct(found)), gold, take))
