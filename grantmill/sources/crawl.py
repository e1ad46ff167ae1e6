"""Crawls: pages found from starts by their links, level by level, resumable.

Level 0 are the starts. A level's pages are fetched; those that failed are fetched again,
up to ``tries`` times; then the level's links lead to the next level, less every page that
was seen before (an anti-join against all levels). It ends when nothing new is found. Since
a level is closed before the next one begins, a page's depth is the least number of links
to it over pages that could be fetched, whatever had to be tried again.

Every step is a written table below ``path``: ``pages`` (url, depth, ok, tries, and what the
getter returns), ``links`` (url, to). Each has a folder for each level, and a level counts
once all its folders are complete, so a crawl that was cut short goes on where it stopped:
levels that are done aren't fetched again, and the one that was under way is made anew.

Defined results: repeated starts and links count once, null ones not at all; a page that
never comes has ok = false, its last try's columns, and no links; an answer that the getter
doesn't give is a failure. Circles and links to the page itself lead to nothing new.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, stored
from .tables import anchors

#: From (url) and the number of the try, (url, ok, ...): what came back. Rows may be missing.
Getter = Callable[[DataFrame, int], DataFrame]


def resolved(base: Column | str, href: Column | str) -> Column:
    """The address that a link of a page leads to, without its fragment; null if it is none of http or https."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b: str | None, h: str | None) -> str | None:
            try:
                to = urldefrag(urljoin(b or "", (h or "").strip()))[0] if h is not None else ""
            except ValueError:  # no address at all
                return None
            return to if to.lower().startswith(("http://", "https://")) else None

        return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype=object)

    return run(base, href)


def page_links(fetched: DataFrame) -> DataFrame:
    """(url, to) of every link in (url, html)."""
    return anchors(fetched.select("url", "html")).select("url", resolved("url", "href").alias("to"))


def _complete(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


class Crawl:
    def __init__(self, spark: SparkSession, path: str, get: Getter, links: Callable[[DataFrame], DataFrame] = page_links, tries: int = 3):
        self.spark, self.path, self.get, self.links_of, self.tries = spark, path.rstrip("/"), get, links, tries

    def _level(self, what: str, depth: int) -> str:
        return f"{self.path}/{what}/depth={depth}"

    def run(self, starts: DataFrame, levels: int | None = None) -> DataFrame:
        """Crawl until nothing new is found, or for so many levels; the pages. starts: url."""
        depth = self.done()
        while levels is None or depth < levels:
            frontier = stored(self._frontier(starts, depth), "frontier")
            if not frontier.take(1):
                break
            delete(self.spark, self._level("pages", depth), self._level("links", depth))
            self._fetch(frontier).write.parquet(self._level("pages", depth))
            fetched = self.spark.read.parquet(self._level("pages", depth)).where("ok")
            found = self.links_of(fetched).select("url", "to").where("url IS NOT NULL AND to IS NOT NULL").distinct()
            found.write.parquet(self._level("links", depth))
            depth += 1
        return self.pages()

    def done(self) -> int:
        """Levels that are complete."""
        depth = 0
        while _complete(self.spark, self._level("links", depth)):
            depth += 1
        return depth

    def _frontier(self, starts: DataFrame, depth: int) -> DataFrame:
        if depth == 0:
            return starts.select("url").where("url IS NOT NULL").distinct()
        seen = self.spark.read.parquet(*(self._level("pages", d) for d in range(depth))).select("url")
        new = self.spark.read.parquet(self._level("links", depth - 1)).select(F.col("to").alias("url")).distinct()
        return new.join(seen, "url", "left_anti")

    def _fetch(self, frontier: DataFrame) -> DataFrame:
        """(url, ok, tries, ...) of a level; what has failed is asked for again."""
        left, closed = frontier, []
        for n in range(1, self.tries + 1):
            came = self.get(left, n)
            rest = [c for c in came.columns if c != "url"]
            asked = left.join(came, "url", "left").select("url", F.coalesce("ok", F.lit(False)).alias("ok"), F.lit(n).alias("tries"), *(c for c in rest if c != "ok"))
            got = stored(asked, "fetched")
            failed = got.where("NOT ok")
            if n == self.tries or not failed.take(1):
                closed.append(got)
                break
            closed.append(got.where("ok"))
            left = failed.select("url")
        out = closed[0]
        for one in closed[1:]:
            out = out.unionByName(one)
        return out

    def _table(self, what: str) -> DataFrame:
        n = self.done()
        if not n:
            raise ValueError(f"{self.path}: nothing was crawled")
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*(self._level(what, d) for d in range(n)))

    def pages(self) -> DataFrame:
        """url, ok, tries, what the getter gave, depth."""
        return self._table("pages")

    def links(self) -> DataFrame:
        """url, to, depth (of url)."""
        return self._table("links")
