"""Pipeline A: domains -> base URL -> robots/sitemap (or crawl) -> gated
candidate pages (or the homepage) -> page text -> plain identifiers ->
one report row per input domain, plus run counters.

Shuffles: the URL joins against the snapshot (hash of ``url``, or a broadcast
of the written URL list where its known size allows) and the per-domain set
union (hash of domain/value after a map-side distinct).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlfold.functions.extract import email_plain, siren_plain, siret_plain
from crawlfold.functions.text import page_text
from crawlfold.operators.crawl import crawl_bfs, links_of
from crawlfold.operators.links import footer_links_a, page_links, scoped_links
from crawlfold.operators.site import (
    Pages, base_urls, candidates_gate, homepage_fallback, page_lookup, report_cells, report_rows, request_log, run_stats,
    union_per_domain,
)
from crawlfold.operators.sitemaps import expand_sitemaps, robots_sitemap
from crawlfold.session import cut_lineage, width
from crawlfold.sources.store import store_of
from crawlfold.sources.tables import write_ordered_csv

# limits of the written report: characters of a file, and of the domains' cells that every task may hold
FILE_CHARS = 64 << 20
CELLS_CHARS = 32 << 20


@dataclass
class ResultA:
    report: DataFrame
    stats: DataFrame
    candidates: DataFrame
    page_ids: DataFrame
    cells: DataFrame


def extract_pages_a(pages: DataFrame, ignored=(), compat: bool = False, body: str = "body") -> DataFrame:
    """``(url, siren, siret, emails)`` per page (narrow)."""
    t = pages.withColumn("_text", page_text(F.col(body)))
    return t.select(
        "url",
        siren_plain(F.col("_text"), ignored, compat).alias("siren"),
        siret_plain(F.col("_text"), ignored, compat).alias("siret"),
        email_plain(F.col("_text")).alias("emails"),
    )


def source_urls(bases: DataFrame, snapshot: Pages, links: DataFrame | None = None,
                crawl_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(domain, url)`` page URLs per domain: sitemap URLs when there are
    any, else crawl results (dropped when ``crawl_links`` is False, which is
    what a type check on the crawl's link objects did). Also returns the
    sitemap URL table."""
    store = store_of(snapshot)
    ok = bases.filter(F.col("base_url").isNotNull())
    sm = robots_sitemap(ok, snapshot, "base_url", mode="a")
    sm_urls = expand_sitemaps(sm.select("domain", "sitemap_url"), snapshot, mode="a")
    urls = sm_urls.select("domain", "url")
    if not crawl_links:
        return urls, sm_urls
    need = ok.join(sm_urls.select("domain").distinct(), "domain", "left_anti")
    seeds = need.join(store.available().select(F.col("url").alias("base_url")), "base_url", "left_semi").select(
        F.col("domain").alias("site"), F.col("base_url").alias("base"))
    seeds = cut_lineage(seeds)
    if links is None:
        links = links_of(store, page_links)
    homes = store.fetch(seeds.select(F.col("base").alias("url")))
    scoped = scoped_links(homes).join(seeds.select(F.col("base").alias("url"), "site", "base"), "url")
    footer = footer_links_a(scoped, "base").select("site", "link", "text", "label", "pos")
    crawled = crawl_bfs(seeds, links, footer)
    return urls.unionByName(crawled.select(F.col("site").alias("domain"), "url")), sm_urls


def pipeline_a(domains: DataFrame, snapshot: Pages, links: DataFrame | None = None, ignored=(),
               crawl_links: bool = True, compat: bool = False) -> ResultA:
    """The whole of pipeline A over ``domains(domain[, input_pos, error])``."""
    bases = cut_lineage(base_urls(domains, snapshot))
    urls, _ = source_urls(bases, snapshot, links, crawl_links=crawl_links and not compat)
    # read for the candidates, the domains without any, and the legal pages; scored by all tasks, as a site's
    # URLs come out of one sitemap
    gated = cut_lineage(candidates_gate(urls.repartition(width(urls.sparkSession))))
    cands = gated.select("domain", "url").distinct()
    targets = cut_lineage(homepage_fallback(bases, cands))
    pages = page_lookup(targets, snapshot)
    per_page = cut_lineage(extract_pages_a(pages, ignored, compat))  # read for each kind of identifier
    found = targets.join(per_page, "url")
    sets = union_per_domain(found)
    cells = cut_lineage(report_cells(bases, sets))
    report = report_rows(domains, cells)
    legal_rows = gated.filter("legal").join(domains.select("domain"), "domain")
    stats = run_stats(report, legal_rows, request_log(domains, bases))
    return ResultA(report=report, stats=stats, candidates=targets, page_ids=per_page, cells=cells)


def write_report_a(domains: DataFrame, cells: DataFrame, path: str) -> None:
    """Write the report of ``domains(input_pos, domain[, error])`` as CSV files in input
    order. Its rows hold all of a domain's values, and many may name one domain: rows
    are dealt to files without them, which each task then adds, as long as the cells
    of all domains fit in a task; the number of files follows the characters to write."""
    long = F.length(F.concat_ws("", "base_url", "siren", "siret", "emails")).cast("bigint")
    sized = cells.select("domain", long.alias("_long"))
    held = sized.agg(F.sum("_long")).first()[0] or 0
    written = domains.groupBy("domain").count().join(sized, "domain").agg(F.sum(F.col("count") * F.col("_long"))).first()[0] or 0
    files = max(int(domains.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written // FILE_CHARS))
    if held <= CELLS_CHARS:
        write_ordered_csv(domains, path, files=files, finish=lambda rows: report_rows(rows, F.broadcast(cells)))
    else:
        write_ordered_csv(report_rows(domains, cells), path, files=files)
