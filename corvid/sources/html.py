"""HTML pages to entries, links and article text, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object"}
FURNITURE = {"nav", "footer", "header", "aside", "form"}
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "pre", "blockquote", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "dt", "dd", "br", "main", "hr"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}


class Page(HTMLParser):
    """Reads a page as a stream, whatever its depth: title, sections, links, and text outside furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = self.furniture = 0
        self.open: list[str] = []
        self.title, self.in_title = "", False
        self.sections: list[tuple[int, str, list[str]]] = [(0, "", [])]
        self.links: list[tuple[str, str, bool]] = []
        self.link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self._text("\n")
            return
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr") and self.open and self.open[-1] == tag:
            self.open.pop()  # the end tag may be left out
        self.open.append(tag)
        self.skip += tag in DROPPED
        self.furniture += tag in FURNITURE
        if tag == "title":
            self.in_title = True
        elif tag in HEADINGS and not self.furniture:
            self.sections.append((HEADINGS[tag], "", []))
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.link = (href, [])
        if tag in BLOCKS:
            self._text("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.skip -= last in DROPPED
            self.furniture -= last in FURNITURE
            if last == tag:
                break
        if tag == "title":
            self.in_title = False
        elif tag in HEADINGS and self.sections[-1][1] == "":
            level, _, text = self.sections[-1]
            self.sections[-1] = (level, " ".join("".join(text).split()), [])
        elif tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split()), self.furniture > 0))
            self.link = None
        if tag in BLOCKS:
            self._text("\n")

    def _text(self, data: str) -> None:
        if not self.furniture:
            self.sections[-1][2].append(data)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            if self.link:
                self.link[1].append(data)
            self._text(data)


def _tidy(parts: list[str]) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


def read(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def sections(pages: DataFrame) -> DataFrame:
    """page_id, n, level, title, text: the page itself (level 0), then a row for each heading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.page_id, batch.html):
                page = read(html)
                for n, (level, title, text) in enumerate(page.sections):
                    rows.append((page_id, n, level, title if n else " ".join(page.title.split()), _tidy(text)))
            yield pd.DataFrame(rows, columns=["page_id", "n", "level", "title", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, n int, level int, title string, text string")


def links(pages: DataFrame) -> DataFrame:
    """page_id, n, href, text, menu (inside navigation, header or footer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page_id, n, *link) for page_id, html in zip(batch.page_id, batch.html) for n, link in enumerate(read(html).links)]
            yield pd.DataFrame(rows, columns=["page_id", "n", "href", "text", "menu"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, n int, href string, text string, menu boolean")


def articles(pages: DataFrame) -> DataFrame:
    """page_id, title, text: the page's text outside navigation and other furniture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.page_id, batch.html):
                page = read(html)
                heads = [t for level, t, _ in page.sections if level == 1]
                rows.append((page_id, (heads or [" ".join(page.title.split())])[0], "\n".join(filter(None, (x for _, t, p in page.sections for x in (t, _tidy(p)))))))
            yield pd.DataFrame(rows, columns=["page_id", "title", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")
