"""Texts as columns: sentences, tokens, token windows, cleaned HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content isn't text of the page.
STRIPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript")


def _full(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space, trimmed, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return _full(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return _full(F.split(text, r"\s+"))


def once(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it: as the variable of a lambda over an array of one."""
    return F.element_at(F.transform(F.array(x), f), 1)


def token_windows(words: Column, n: int) -> Column:
    """Consecutive windows of n tokens, each joined by spaces; none for no tokens. Linear in the tokens."""

    def cut(w: Column) -> Column:
        count = F.ceil(F.size(w) / n).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * n + 1, n), " "))

    return once(words, cut)


def collapse_blank_lines(text: Column) -> Column:
    """Lines without trailing white space, runs of blank ones as one, none at the ends."""
    trimmed = F.regexp_replace(text, r"[ \t\r\f]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def clean_html(html: Column) -> Column:
    """The text of a page, a line for each run between tags."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in STRIPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"<[^>]*>", "\n")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse_blank_lines(out)


def hrefs(html: Column) -> Column:
    """Targets of links, in order, without fragments."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1), lambda x: F.regexp_replace(x, "#.*$", ""))
