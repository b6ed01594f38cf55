"""A page store: bodies beside a narrow url index.

Every question that needs no page text (was this URL fetched, which snapshot has
it, which kind of file is it) is answered by the index, which a crawler writes
when it stores a page. Only then bodies are read, once, by a join with the
chosen URLs; where the snapshot is partitioned by ``kind``, that join carries the
partition column, so Spark prunes the other kinds' files.

A plain snapshot ``(url, body)`` serves too: its index is then read off the bodies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlfold.sources.tables import fetched

STATIC, RENDERED = 0, 1  # rank of a source: a static page goes before a rendered one


def url_index(static: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """``(url, source, kind, ok, n_chars)`` of the stored files; ``kind`` is the
    snapshot's, ``'page'`` where it names none."""
    def one(df: DataFrame, source: int) -> DataFrame:
        kind = F.col("kind") if "kind" in df.columns else F.lit("page")
        ok = F.coalesce(F.col("body") != "", F.lit(False))
        return df.select("url", F.lit(source).alias("source"), kind.alias("kind"), ok.alias("ok"),
                         F.coalesce(F.length("body"), F.lit(0)).cast("bigint").alias("n_chars"))
    out = one(static, STATIC)
    return out if rendered is None else out.unionByName(one(rendered, RENDERED))


@dataclass(frozen=True)
class PageStore:
    """Static pages, pages as a browser rendered them, and the index of both."""

    static: DataFrame
    rendered: DataFrame | None = None
    index: DataFrame | None = None

    def available(self, rendered: bool = False) -> DataFrame:
        """``(url)`` of the non-empty files; rendered ones too if asked."""
        if self.index is not None:
            found = self.index.filter(F.col("ok") if rendered else F.col("ok") & (F.col("source") == STATIC)).select("url")
        else:
            found = fetched(self.static).select("url")
            if rendered and self.rendered is not None:
                found = found.unionByName(fetched(self.rendered).select("url"))
        return found.distinct() if rendered else found

    def choose(self, urls: DataFrame, rendered: bool = True) -> DataFrame:
        """``(url, source, kind)``: where each distinct URL is to be read from,
        the static page before the rendered one; URLs without a page are left out."""
        index = self.index if self.index is not None else url_index(self.static, self.rendered)
        index = index.filter(F.col("ok") if rendered else F.col("ok") & (F.col("source") == STATIC))
        both = urls.select("url").distinct().join(index.select("url", "source", "kind"), "url")
        if not rendered or self.rendered is None:
            return both
        return both.groupBy("url").agg(F.min(F.struct("source", "kind")).alias("at")).select("url", "at.source", "at.kind")

    def fetch(self, urls: DataFrame, rendered: bool = False) -> DataFrame:
        """``(url, body)`` of the distinct ``urls`` that have a page."""
        if self.index is None and (not rendered or self.rendered is None):
            return fetched(self.static).join(urls.select("url").distinct(), "url", "left_semi").select("url", "body")
        chosen = self.choose(urls, rendered)
        out = _bodies(self.static, chosen.filter(F.col("source") == STATIC))
        if rendered and self.rendered is not None:
            out = out.unionByName(_bodies(self.rendered, chosen.filter(F.col("source") == RENDERED)))
        return out

    def fetch_rendered(self, urls: DataFrame) -> DataFrame:
        """``(url, body)`` of the rendered pages among ``urls`` only."""
        return fetched(self.rendered).join(urls.select("url").distinct(), "url", "left_semi").select("url", "body")


def _bodies(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    on = ["url", "kind"] if "kind" in pages.columns else ["url"]
    return pages.join(chosen.select(*on), on, "left_semi").select("url", "body")


def store_of(pages: PageStore | DataFrame, rendered: DataFrame | None = None) -> PageStore:
    """A store as it is, or one of plain snapshots without an index."""
    return pages if isinstance(pages, PageStore) else PageStore(pages, rendered)


def resolve_redirects(redirects: DataFrame, max_hops: int = 30) -> DataFrame:
    """``(url, final_url)``: where the chain of ``redirects(url, location)`` from
    each URL ends. Chains of more than ``max_hops`` and cycles have no end and are
    left out. Each round doubles the hops that every URL has followed."""
    from crawlfold.session import cut_lineage

    sources = redirects.select("url").distinct()
    now = cut_lineage(redirects.groupBy("url").agg(F.min("location").alias("final_url")).select("url", "final_url", F.lit(1).alias("hops")))
    reach = 1
    while reach <= max_hops:
        ahead = now.select(F.col("url").alias("final_url"), F.col("final_url").alias("_next"), F.col("hops").alias("_more"))
        longer = now.join(ahead, "final_url", "left")
        now, last = cut_lineage(longer.select(
            "url", F.coalesce("_next", "final_url").alias("final_url"),
            (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))), now
        reach *= 2
        if now.agg(F.sum("hops")).first() == last.agg(F.sum("hops")).first():
            break
    return now.filter(F.col("hops") <= max_hops).join(sources.select(F.col("url").alias("final_url")), "final_url", "left_anti").select("url", "final_url")
