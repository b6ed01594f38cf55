"""Pipeline B: a three-stage cascade per domain, each stage only for the
domains that still have no identifier or e-mail:

1. sitemap URLs (lenient parsing), scored by URL, top 10;
2. site crawl (footer / keyword / frame links), scored by URL, top 10,
   pages already read in stage 1 skipped;
3. the rendered homepage.

Pages are read static-first with the rendered snapshot as fallback and go
through the context-gated extraction. Between stages the remaining domains
are a left-anti join on the domains already served.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlfold.functions.extract import extract_context
from crawlfold.functions.scoring import score_sum
from crawlfold.functions.text import page_text
from crawlfold.operators.crawl import crawl_site, links_of
from crawlfold.operators.links import scoped_links
from crawlfold.operators.site import Pages, base_urls, identifiers, report_b, sets_of, top_urls
from crawlfold.operators.sitemaps import expand_sitemaps, robots_sitemap
from crawlfold.session import cut_lineage
from crawlfold.sources.store import PageStore, store_of


@dataclass
class ResultB:
    report: DataFrame
    ids: DataFrame  # (domain, kind, value)

    @property
    def sets(self) -> DataFrame:
        return sets_of(self.ids)


def extract_pages_b(pages: DataFrame, body: str = "body", strip_spaces: bool = False) -> DataFrame:
    """``(url, siren, siret, emails)`` per page with the context rules."""
    t = pages.withColumn("text", page_text(F.col(body)))
    return extract_context(t, "text", strip_spaces=strip_spaces).select("url", "siren", "siret", "emails")


def _served(found: DataFrame) -> DataFrame:
    has = (F.size("siren") > 0) | (F.size("siret") > 0) | (F.size("emails") > 0)
    return found.filter(has).select("domain").distinct()


def _read(targets: DataFrame, store: PageStore) -> DataFrame:
    pages = store.fetch(targets, rendered=True)
    return targets.join(extract_pages_b(pages), "url")


def sitemap_urls_b(bases: DataFrame, pages: Pages) -> DataFrame:
    """Lenient sitemap URLs, with the fallback for documents that are no XML."""
    sm = robots_sitemap(bases, pages, "base_url", mode="b").select("domain", "sitemap_url")
    return expand_sitemaps(sm, pages, mode="lenient")


def pipeline_b(domains: DataFrame, pages: Pages, rendered: DataFrame | None = None, redirects: DataFrame | None = None,
               scoped: DataFrame | None = None, keep_partial: bool = False) -> ResultB:
    """The cascade over ``domains(domain[, input_pos])``; ``pages`` is a store, or a
    snapshot with ``rendered`` beside it."""
    store = store_of(pages, rendered)
    bases = cut_lineage(base_urls(domains, store, redirects).filter(F.col("base_url").isNotNull()))
    # stage 1: sitemap
    sm = sitemap_urls_b(bases, store).withColumn("score", score_sum(F.col("url")))
    t1 = cut_lineage(top_urls(sm).select("domain", "url"))
    f1 = cut_lineage(_read(t1, store))
    # stage 2: crawl, for domains with nothing yet
    rest = bases.join(_served(f1), "domain", "left_anti")
    seeds = cut_lineage(rest.select(F.col("domain").alias("site"), F.col("base_url").alias("base")))
    crawled = crawl_site(seeds, scoped if scoped is not None else links_of(store, scoped_links, rendered=True))
    crawled = crawled.withColumnRenamed("site", "domain")
    scored = crawled.withColumn("score", score_sum(F.col("url"))).withColumn("ord", F.col("url"))
    # what is read more than once is written: every reader would work it out anew
    t2 = cut_lineage(top_urls(scored).select("domain", "url").join(t1, ["domain", "url"], "left_anti"))
    f2 = cut_lineage(_read(t2, store))
    found = f1.unionByName(f2)
    # stage 3: the rendered homepage
    if store.rendered is not None:
        homes = seeds.select(F.col("site").alias("domain"), F.col("base").alias("url")).join(_served(f2), "domain", "left_anti")
        f3 = cut_lineage(homes.join(extract_pages_b(store.fetch_rendered(homes)), "url"))
        found = found.unionByName(f3.select(found.columns))
    ids = cut_lineage(identifiers(found))
    return ResultB(report=report_b(domains, ids, keep_partial=keep_partial), ids=ids)
