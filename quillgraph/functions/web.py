"""Web pages: text and metadata from markup, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import col, strip

#: Elements whose content is no main text.
SKIPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "table", "noscript")


def _without(html: Column, names: tuple[str, ...]) -> Column:
    out = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for name in names:
        out = F.regexp_replace(out, f"(?is)<{name}\\b[^>]*>.*?</{name}\\s*>", " ")
    return out


def visible_text(html: str | Column) -> Column:
    """All text outside scripts, styles and comments, white space collapsed: the baseline extractor."""
    plain = F.regexp_replace(_without(col(html), ("script", "style")), "(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(_entities(plain), "\\s+", " "))


def _entities(text: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, name, char)
    return text


def main_text(html: str | Column) -> Column:
    """Text of the page's paragraphs and headings, each once, without boilerplate elements; empty if none."""
    kept = _without(col(html), SKIPPED)
    parts = F.regexp_extract_all(kept, F.lit("(?is)<(?:p|h[1-6]|li|blockquote)\\b[^>]*>(.*?)</(?:p|h[1-6]|li|blockquote)\\s*>"), F.lit(1))
    clean = F.transform(parts, lambda x: strip(F.regexp_replace(_entities(F.regexp_replace(x, "(?s)<[^>]*>", " ")), "\\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(clean, lambda x: x != "")), "\n")


def extracted(html: str | Column) -> tuple[Column, Column]:
    """Text and the method that gave it: main extraction, else the baseline, else none."""
    main, base = F.nullif(main_text(html), F.lit("")), F.nullif(visible_text(html), F.lit(""))
    method = F.when(main.isNotNull(), F.lit("bare_extraction")).when(base.isNotNull(), F.lit("baseline")).otherwise(F.lit("none"))
    return F.coalesce(main, base), method


def title(html: str | Column) -> Column:
    return F.nullif(strip(F.regexp_extract(col(html), "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language(html: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(html), "(?is)<html[^>]*\\blang=[\"']?([A-Za-z-]+)", 1), F.lit(""))


def meta(html: str | Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(col(html), f"(?is)<meta[^>]*\\b(?:name|property)=[\"']?{name}[\"'][^>]*\\bcontent=[\"']([^\"']*)[\"']", 1), F.lit(""))


def hostname(url: str | Column, meta_host: str | Column | None = None) -> Column:
    host = F.try_parse_url(col(url), F.lit("AUTHORITY"))
    return F.coalesce(col(meta_host), host) if meta_host is not None else host
