"""The main text of pages, by a parser of the standard library; for pages whose structure patterns can't follow."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.functions.text import STRIPPED

#: Where the main text is looked for, in this order: tag, attribute, value.
SELECTORS = (("article", "", ""), ("main", "", ""), ("", "role", "main"), ("", "class", "content"), ("", "id", "content"), ("", "class", "docs-content"), ("", "class", "markdown-body"), ("body", "", ""))
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _matches(tag: str, attrs: dict[str, str], selector: tuple[str, str, str]) -> bool:
    name, key, value = selector
    if name and tag != name:
        return False
    return not key or (value in attrs.get(key, "").split() if key == "class" else attrs.get(key) == value)


class _Page(HTMLParser):
    """Texts between tags, with the first element of each selector that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, list[int]]] = []
        self.taken: set[int] = set()
        self.texts: list[tuple[str, frozenset[int]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        hidden = tag in STRIPPED or any(h for _, h, _ in self.stack)
        first = [i for i, s in enumerate(SELECTORS) if not hidden and i not in self.taken and _matches(tag, given, s)]
        self.taken.update(first)
        self.stack.append((tag, hidden, first))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not any(h for _, h, _ in self.stack):
            self.texts.append((data, frozenset(i for _, _, own in self.stack for i in own)))

    def main(self) -> str:
        best = min(self.taken, default=None)
        lines = [x.rstrip() for x in "\n".join(t for t, own in self.texts if best is None or best in own).split("\n")]
        kept = [x for k, x in enumerate(lines) if x.strip() or k == 0 or lines[k - 1].strip()]
        return "\n".join(kept).strip()


def main_text(html: str | None) -> str:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.main()


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id and text of pages (page_id, html), in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "text": [main_text(x) for x in f["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")
