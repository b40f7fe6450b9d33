"""A web page as one record: title, text, links and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import html_to_text

_LINK = r"(?is)<a\s[^>]*>.*?</a>"
_IMAGE = r"(?is)<img\s[^>]*>"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted either way; '' where it has none."""
    double = F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    return F.trim(F.when(double != "", double).otherwise(single))


def capture(html: Column) -> Column:
    """struct<title, text, links: array<struct<text, href>>, images: array<struct<alt, src>>>.

    Links without an address and images without a source are left out. A null page gives null.
    """
    head = lambda tag: F.regexp_extract(tag, r"(?is)^<[^>]*>", 0)
    links = F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda x: F.struct(html_to_text(x).alias("text"), attribute(head(x), "href").alias("href")))
    images = F.transform(F.regexp_extract_all(html, F.lit(_IMAGE), F.lit(0)), lambda x: F.struct(attribute(x, "alt").alias("alt"), attribute(x, "src").alias("src")))
    title = html_to_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    record = F.struct(title.alias("title"), html_to_text(html).alias("text"), F.filter(links, lambda x: x["href"] != "").alias("links"), F.filter(images, lambda x: x["src"] != "").alias("images"))
    return F.when(html.isNotNull(), record)
