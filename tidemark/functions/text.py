"""Text expressions and the few text functions that no built-in expression covers."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keywords of a title, and words that stand for no entity.
TITLE_KEYWORDS = ("the", "for", "with", "der", "die", "las", "les")
NONE_WORDS = ("none", "n/a", "null", "-")
# What marks the element of one product, and how many make a list.
PRODUCT_ATTRIBUTE = "prdid"
PRODUCT_CLASSES = ("product", "item", "pass", "card")
PRODUCTS_LEAST = 5
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def preprocess(c: Column) -> Column:
    """Everything but letters, digits, _ and whitespace becomes a space; runs of whitespace become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_ \t\n\r\f\x0B]", " "), r"[ \t\n\r\f\x0B]+", " "))


def keep_basic(c: Column) -> Column:
    """Everything but ASCII letters, digits, Hangul syllables and whitespace becomes a space."""
    return F.regexp_replace(c, "[^a-zA-Z0-9가-힣 \\t\\n\\r\\f\\x0B]", " ")


def clean(c: Column) -> Column:
    """Drops control and zero-width characters, unifies line ends, folds blank lines."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F​‌‍﻿]", "")
    return F.regexp_replace(c, "\n[ \t\n]*\n", "\n\n")


def strip_links(c: Column) -> Column:
    """Removes URLs and mail addresses."""
    return F.regexp_replace(F.regexp_replace(c, r"https?://[^ \t\n\"<>]+", ""), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")


def html_to_text(c: Column) -> Column:
    """Drops scripts, styles, comments and tags; entities of the basic kind become characters."""
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        c = F.regexp_replace(c, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def normalize_entity(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), " +", " "))


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams of a string of at least n characters; a shorter string is its only one."""
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, n))
    return F.array_distinct(spans)


def bigrams(c: Column) -> Column:
    """Lower-cased bigrams over ASCII letters, digits and Hangul."""
    return char_ngrams(F.lower(F.regexp_replace(c, "[^가-힣a-zA-Z0-9]", "")), 2)


def word_ngrams(words: Column, low: int, high: int) -> Column:
    """Structs (gram, start, end) of all runs of low to high words; empty where the text has too few."""
    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("gram"), i.alias("start"), (i + n).alias("end")))

    return F.flatten(F.array(*map(runs, range(low, high + 1))))


def maximal_strings(a: Column) -> Column:
    """The strings of a that lie in no other string of a."""
    return F.filter(F.array_distinct(a), lambda x: ~F.exists(a, lambda y: (y != x) & F.contains(y, x)))


def parse_entity_line(c: Column) -> Column:
    """The entities after 'ENTITY:', split at pipes or else commas; empty, overlong and none-words dropped."""
    body = F.trim(F.regexp_replace(c, "(?is)^.*ENTITY:", ""))
    parts = F.split(body, F.when(F.contains(body, F.lit("|")), F.lit(r"\|")).otherwise(F.lit(",")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) <= 200) & ~F.lower(x).isin(*NONE_WORDS))


def chunk(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most size characters; each is cut after the last of the first separator that lies beyond the overlap.

    A new piece starts overlap characters before the last one's end, and always further on than the last one's start.
    """
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for s in separators:
                cut = text.rfind(s, at + overlap, end)
                if cut > at + overlap:
                    end = cut + len(s)
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_udf(size: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else chunk(x, size, overlap))

    return run


class _Elements(HTMLParser):
    """Spans of the elements that mark a product, by attribute and by class, in order of their start."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.open: list[tuple[str, int, bool, bool]] = []
        self.by_attribute: list[tuple[int, int]] = []
        self.by_class: list[tuple[int, int]] = []
        self.feed(html)
        self.close()
        while self.open:
            self._end(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _end(self, end: int) -> None:
        _, start, attribute, cls = self.open.pop()
        if attribute:
            self.by_attribute.append((start, end))
        if cls:
            self.by_class.append((start, end))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        got = dict(attrs)
        cls = (got.get("class") or "").lower()
        self.open.append((tag, self._at(), PRODUCT_ATTRIBUTE in got, any(w in cls for w in PRODUCT_CLASSES)))
        if tag in _VOID:
            self._end(self._at() + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end(self._at() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, *_ in self.open):
            return
        while self.open[-1][0] != tag:
            self._end(self._at())  # left open inside
        self._end(self._at() + len(tag) + 3)


def chunk_html(html: str, size: int) -> list[str]:
    """A page in chunks of at most ``size`` characters, or one more a line break: whole products where five or more are marked, else slices.

    A page that fits is one chunk, an empty one included. Products within products count
    for themselves; a product over ``size`` is sliced alone.
    """
    if len(html) <= size:
        return [html]
    slices = lambda s: [s[i : i + size] for i in range(0, len(s), size)]
    marked = _Elements(html)
    spans = next((x for x in (marked.by_attribute, marked.by_class) if len(x) >= PRODUCTS_LEAST), None)
    if spans is None:
        return slices(html)
    out, now = [], ""
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        one = html[a:b]
        if now and len(now) + len(one) > size:
            out.append(now)
            now = ""
        if len(one) > size:
            out += slices(one)
        else:
            now = f"{now}\n{one}" if now else one
    return [*out, now] if now else out


def chunk_html_udf(size: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else chunk_html(x, size))

    return run


def repair_json(text: str) -> dict | None:
    """The first JSON object in text, with single quotes, bare keys and spare commas put right; None if there is none."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quote, end = 0, "", len(text)
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            quote = "" if ch == quote and text[i - 1] != "\\" else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                end = i + 1
                break
    body = text[start:end]
    for fix in (lambda s: s, lambda s: re.sub(r",\s*(?=[,}\]])", "", s), lambda s: re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s), lambda s: s.replace("'", '"')):
        body = fix(body)
        try:
            got = json.loads(body)
        except ValueError:
            continue
        return got if isinstance(got, dict) else None
    return None


@F.pandas_udf(T.StringType())
def repair_json_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None or (got := repair_json(x)) is None else json.dumps(got, sort_keys=True, ensure_ascii=False))


def resolve_spans(spans: list[dict]) -> list[dict]:
    """Of overlapping matches (start, end, score, entity) those that stay, by start.

    Best score first, then the shorter. A match of 90 or more goes only if a kept one
    of the same entity of 90 or more covers over 30 % of it; others go if any kept
    match covers over 70 % of them.
    """
    kept: list[dict] = []
    for m in sorted(spans, key=lambda x: (-x["score"], x["end"] - x["start"], x["start"], x["entity"])):
        size = max(1, m["end"] - m["start"])
        cover = lambda k, m=m: max(0, min(k["end"], m["end"]) - max(k["start"], m["start"]))
        if m["score"] >= 90:
            hit = any(k["entity"] == m["entity"] and k["score"] >= 90 and cover(k) > 0.3 * size for k in kept)
        else:
            hit = any(cover(k) > 0.7 * size for k in kept)
        if not hit:
            kept.append(m)
    return sorted(kept, key=lambda x: (x["start"], x["end"]))
