"""Facts from stored HTML pages.

Links, titles and catalog entries are regular expressions inside Spark SQL; only nested sections
need a parser, which runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewscope.functions.text import unescape_html

LINK = r'<a\b[^>]*?\bhref="([^"]*)"'
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# The markup of the stored pages, as patterns and (tag, class) pairs.  All of them are
# parameters of the operators.
HEADING = r'(?s)<div\b[^>]*class="[^"]*\bapphub_AppName\b[^"]*"[^>]*>(.*?)</div>'
TITLE_MARKER = " on Steam"


@dataclass(frozen=True)
class CatalogMarkup:
    """How one entry looks on a search-result page (patterns with one group each)."""

    item: str = r'(?s)<a\b[^>]*class="[^"]*\bsearch_result_row\b[^"]*"[^>]*>.*?</a>'
    id: str = r"/app/(\d+)"
    name: str = r'(?s)<span\b[^>]*class="[^"]*\btitle\b[^"]*"[^>]*>(.*?)</span>'
    release_date: str = r'(?s)<div\b[^>]*class="[^"]*\bsearch_released\b[^"]*"[^>]*>(.*?)</div>'
    price: str = r'(?s)<div\b[^>]*class="[^"]*\bsearch_price\b[^"]*"[^>]*>(.*?)</div>'


@dataclass(frozen=True)
class SectionMarkup:
    """(tag, class) of a section, its title and its text; class None matches any."""

    section: tuple[str, str | None] = ("div", "detailBox")
    title: tuple[str, str | None] = ("div", "subSectionTitle")
    content: tuple[str, str | None] = ("div", "subSectionDesc")


def plain_text(html: Column) -> Column:
    """Tags removed, entities resolved, outer blanks trimmed."""
    return F.regexp_replace(unescape_html(F.regexp_replace(html, "<[^>]*>", "")), r"^\s+|\s+$", "")


def extract_page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, position, href) in page order."""
    links = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    found = pages.select("page_id", F.posexplode_outer(links).alias("position", "href"))
    return found.filter(F.col("position").isNotNull())


def extract_catalog(pages: DataFrame, markup: CatalogMarkup = CatalogMarkup(), html: str = "html") -> DataFrame:
    """(page_id, position, id, name, release_date, price); entries without an id are skipped."""
    items = pages.select(
        "page_id",
        F.posexplode_outer(F.regexp_extract_all(html, F.lit(markup.item), F.lit(0))).alias("position", "item"),
    )

    def field(pattern: str) -> Column:
        found = F.get(F.regexp_extract_all("item", F.lit(pattern), F.lit(1)), F.lit(0))
        return F.coalesce(plain_text(found), F.lit("Unknown"))

    key = F.regexp_extract("item", markup.id, 1)
    return items.filter(F.col("position").isNotNull() & (key != "")).select(
        "page_id",
        "position",
        key.alias("id"),
        field(markup.name).alias("name"),
        field(markup.release_date).alias("release_date"),
        F.regexp_replace(field(markup.price), r"\s+", " ").alias("price"),
    )


def extract_page_title(
    pages: DataFrame,
    heading: str = HEADING,
    marker: str = TITLE_MARKER,
    html: str = "html",
) -> DataFrame:
    """(page_id, name): the heading, else the title up to the marker if it has one, else "Game {id}"."""

    def first(pattern: str) -> Column:
        return F.get(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.lit(0))

    title = unescape_html(first(r"(?s)<title\b[^>]*>(.*?)</title>"))
    cut = F.regexp_replace(F.substring_index(title, marker, 1), r"^\s+|\s+$", "")
    by_title = F.when(F.contains(title, F.lit(marker)), cut)
    fallback = F.concat(F.lit("Game "), F.col("page_id").cast("string"))
    return pages.select("page_id", F.coalesce(plain_text(first(heading)), by_title, fallback).alias("name"))


class _Sections(HTMLParser):
    """Collects title and text pieces of every section while a page streams through."""

    def __init__(self, markup: SectionMarkup):
        super().__init__(convert_charrefs=True)
        self.markup = markup
        self.path: list[tuple[str, str | None]] = []
        self.sections: list[dict[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        role = None
        for name in ("section", "title", "content"):
            want, cls = getattr(self.markup, name)
            if tag == want and (cls is None or cls in classes):
                role = name
                break
        if role == "section":
            self.sections.append({})
        elif role and (not self._open("section") or role in self.sections[-1]):
            role = None
        elif role:
            self.sections[-1][role] = []
        self.path.append((tag, role))

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if piece and self.sections:
            for role in ("title", "content"):
                if self._open(role):
                    self.sections[-1][role].append(piece)

    def _open(self, role: str) -> bool:
        return any(r == role for _, r in self.path)


def _sections_of(html: str, markup: SectionMarkup) -> list[tuple[int, str, str]]:
    parser = _Sections(markup)
    parser.feed(html or "")
    parser.close()
    out = []
    for i, found in enumerate(parser.sections):
        title = "".join(found["title"]) if "title" in found else "No Title"
        content = "\n".join(found["content"]) if "content" in found else "No Content"
        if not content.replace(" ", ""):
            break
        out.append((i, title, content))
    return out


def extract_page_sections(pages: DataFrame, markup: SectionMarkup = SectionMarkup(), html: str = "html") -> DataFrame:
    """(page_id, sections, guide): sections up to the first blank one, and their joined text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {"page_id": pdf["page_id"], "sections": [_sections_of(h, markup) for h in pdf["html"]]}
            )

    found = pages.select("page_id", F.col(html).alias("html")).mapInPandas(
        run, "page_id long, sections array<struct<pos:int, title:string, content:string>>"
    )
    guide = F.expr(
        "array_join(transform(sections, s -> concat('Section Title: ', s.title, '\\nContent: \\n', s.content, '\\n')), '')"
    )
    return found.withColumn("guide", guide)
