"""Links of HTML pages and their ingest: tags in their scopes, query strings cut off, sequential names, a cap on each page.

Pages are parsed, not matched: attributes in any quotes, character references
and the end of a container count. Only the pages go to Python, only what is
found comes back. A page that is null has no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Most links of a page that are asked for.
MOST = 30


class _Finder(HTMLParser):
    """Values of an attribute of a tag, in order; within the first element of class `container`, if one is given."""

    def __init__(self, tag: str, name: str, css_class: str | None, container: str | None):
        super().__init__(convert_charrefs=True)
        self._tag, self._name, self._class, self._container = tag, name, css_class, container
        self._open: list[str] = []
        self._scope: int | None = None
        self._over = False
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        classes = own.get("class", "").split()
        if self._container is None or (self._scope is not None and not self._over):
            if tag == self._tag and self._name in own and (self._class is None or self._class in classes):
                self.found.append(own[self._name])
        elif self._scope is None and self._container in classes:
            self._scope, self._over = len(self._open), tag in _VOID
        if tag not in _VOID:
            self._open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self._open:
            while self._open.pop() != tag:
                pass
            self._over |= self._scope is not None and len(self._open) <= self._scope


def attribute(html: Column, tag: str, name: str, css_class: str | None = None, container: str | None = None) -> Column:
    """Values of the attribute of every such tag, in order; within the first element with class `container`, if given."""

    @F.arrow_udf("array<string>")
    def found(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for page in pages:
            rows = []
            for text in page:
                finder = _Finder(tag, name, css_class, container)
                finder.feed(text.as_py() or "")
                finder.close()
                rows.append(finder.found)
            yield pa.array(rows, pa.list_(pa.string()))

    return found(html)


def links(pages: DataFrame, tag: str = "a", name: str = "href", css_class: str | None = None, container: str | None = None) -> DataFrame:
    """page_id, place, link (without its query string): a row for every link that is not blank."""
    found = pages.select("page_id", F.posexplode(attribute(F.col("html"), tag, name, css_class, container)).alias("place", "raw"))
    return found.select("page_id", "place", F.substring_index("raw", "?", 1).alias("link")).where(F.trim("link") != "")


def named(found: DataFrame, prefix: str, count: int = 10) -> DataFrame:
    """The first `count` links of each page with sequential names; more than MOST may not be asked for."""
    if count > MOST:
        raise ValueError(f"at most {MOST} links of a page")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("place"))
    return found.withColumn("n", n).where(F.col("n") <= count).select("page_id", "n", F.concat(F.lit(prefix), "n").alias("name"), "link")


def attempted(found: DataFrame, failed: Column, prefix: str, count: int = 10) -> DataFrame:
    """Links in order until `count` of a page are uploaded: page_id, place, name, link, uploaded. What fails is passed over, and its name goes to the next."""
    if count > MOST:
        raise ValueError(f"at most {MOST} links of a page")
    before = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tried = found.withColumn("uploaded", ~failed)
    tried = tried.withColumn("done", F.coalesce(F.sum(F.col("uploaded").cast("int")).over(before), F.lit(0))).where(F.col("done") < count)
    return tried.select("page_id", "place", F.concat(F.lit(prefix), F.col("done") + 1).alias("name"), "link", "uploaded")
