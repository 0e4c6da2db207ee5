"""Links and fields of crawled pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.session import small_batches

# fixed values: class name patterns of the page elements that hold each field
CODE_LINK_CLASS = r"script-code-pane__download.*"
USER_LINK_CLASS = r"kernel-header__username.*"
VOTES_CLASS = r"vote-button__vote-count.*"
LANGUAGE_TEXT = r"(R?(Python)?) notebook"
ITEM_LINK_CLASS = "scripts__item-name"


def anchor_hrefs(html: Column, css_class: str | None = None) -> Column:
    """Distinct href values of anchors (with the class, if given), by regular expression."""
    if css_class is None:
        pattern = r'<a\s[^>]*?href="([^"]*)"'
    else:
        pattern = rf'<a\s[^>]*?class="{re.escape(css_class)}"[^>]*?href="([^"]*)"'
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def extract_links(pages: DataFrame, base: str, css_class: str | None = None) -> DataFrame:
    """Distinct absolute links: root-relative hrefs joined to the base, the rest kept."""
    href = F.explode(anchor_hrefs(F.col("html"), css_class)).alias("href")
    absolute = F.when(F.col("href").startswith("/"), F.concat(F.lit(base.rstrip("/")), "href"))
    return pages.select(href).select(absolute.otherwise(F.col("href")).alias("link")).distinct()


class _Fields(HTMLParser):
    """Collects anchors and the first matching element of each page field."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple[str, str]] = []
        self.code = self.user = self.votes = self.language = None
        self._in_votes = 0

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        names = (known.get("class") or "").split() or [""]
        if tag == "a" and known.get("href") is not None:
            href = known["href"]
            self.anchors.append((" ".join(names), href))
            if self.code is None and any(re.match(CODE_LINK_CLASS, n) for n in names):
                self.code = href
            if self.user is None and any(re.match(USER_LINK_CLASS, n) for n in names):
                self.user = href[1:]
        elif tag == "span":
            if self._in_votes:
                self._in_votes += 1
            elif self.votes is None and any(re.match(VOTES_CLASS, n) for n in names):
                self.votes, self._in_votes = "", 1

    def handle_endtag(self, tag):
        if tag == "span" and self._in_votes:
            self._in_votes -= 1

    def handle_data(self, data):
        if self._in_votes:
            self.votes += data
        if self.language is None and re.search(LANGUAGE_TEXT, data):
            self.language = data.split(" ")[0]


def _parsed(html: str | None) -> _Fields:
    fields = _Fields()
    fields.feed(html or "")
    return fields


def extract_links_html(pages: DataFrame, base: str, css_class: str | None = None) -> DataFrame:
    """As `extract_links`, for any mark-up and any relative link."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {
                urljoin(base, href)
                for html in pdf["html"]
                for names, href in _parsed(html).anchors
                if css_class is None or css_class in names.split()
            }
            yield pd.DataFrame({"link": sorted(found)}, dtype=object)

    return small_batches(pages.select("html")).mapInPandas(links, "link string").distinct()


def _field_rows(htmls) -> Iterator[tuple]:
    """(code, user, votes, language) of each page; its parser and anchors are dropped at once."""
    for html in htmls:
        f = _parsed(html)
        yield f.code, f.user, f.votes, f.language


def extract_page_fields(pages: DataFrame) -> DataFrame:
    """(url, code_link, user, votes, language) of each page; what is missing is null."""
    names = ["code_link", "user", "votes", "language"]

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame(list(_field_rows(pdf["html"])), columns=names, dtype=object)
            found.insert(0, "url", pdf["url"].to_numpy())
            yield found

    rows = small_batches(pages.select("url", "html")).mapInPandas(
        fields, "url string, code_link string, user string, votes string, language string"
    )
    return rows.withColumn("votes", F.expr("try_cast(trim(votes) as int)"))


def classify_file(name: Column) -> Column:
    """Struct (ext, language): notebooks and scripts by extension, null language otherwise."""
    ext = F.substring_index(name, ".", -1)
    language = F.when(ext == "ipynb", "IPython Notebook").when(ext == "py", "Python")
    return F.struct(ext.alias("ext"), language.alias("language"))


def known_links(records: DataFrame, col: str = "link") -> DataFrame:
    return records.select(F.col(col).alias("link")).distinct()


def new_links(found: DataFrame, downloaded: DataFrame, failed: DataFrame) -> DataFrame:
    """Found links that were neither downloaded nor failed before."""
    return (
        found.select("link").distinct().join(known_links(downloaded), "link", "left_anti")
        .join(known_links(failed), "link", "left_anti")
    )
