"""

``entry(spark)`` runs the flagship query (pipeline A report) on sf0.001;
``queries()`` maps every implemented operator to a query over the driver
tables (or inputs Spark derives from them, see ``crawlfold.sources.derived``);
``oracle_sql()`` gives the DuckDB equivalent where one exists.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from crawlfold.functions import extract as E  # noqa: E402
from crawlfold.functions import scoring as S  # noqa: E402
from crawlfold.functions import text as T  # noqa: E402
from crawlfold.functions import urls as U  # noqa: E402
from crawlfold.functions.elements import clean_text  # noqa: E402
from crawlfold.operators import crawl as C  # noqa: E402
from crawlfold.operators import links as L  # noqa: E402
from crawlfold.operators import site as W  # noqa: E402
from crawlfold.operators import sitemaps as SM  # noqa: E402
from crawlfold.operators.ranking import rank_within  # noqa: E402
from crawlfold.plans.pipeline_a import extract_pages_a, pipeline_a, source_urls, write_report_a  # noqa: E402
from crawlfold.plans.pipeline_b import extract_pages_b, pipeline_b, sitemap_urls_b  # noqa: E402
from crawlfold.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402
from crawlfold.sources import derived as D  # noqa: E402
from crawlfold.sources.tables import read_domain_csv, read_ordered_csv, read_table, write_ordered_csv  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"
# FIXED VALUES (test parameter): identifiers put on the ignore list
IGNORED = ["001552081", "00255208100074"]


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def _texts(spark, sf):
    return D.texts(spark, sf)


def _spread_texts(spark, sf):
    """Texts in as many parts as tasks can run at once, however few row groups
    hold them: for queries whose work on a text is much more than its shuffle."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return D.texts(spark, sf).repartition(n, "text_id", "text")


def _site(spark, sf):
    ensure_checkpoint_dir(spark)
    return D.site_snapshot(spark, sf)


def _pages_snapshot(spark, sf):
    """Derived page bodies (pages only, no robots/sitemaps)."""
    return _site(spark, sf)["bodies"].select("url", "body")


def _joined(col):
    return F.array_join(col, ";")


def _nonempty(df, *cols):
    """Rows with a value in one of ``cols``. A filter would be pushed below the
    projection that makes them, and so make them twice; a generator is not."""
    def some(row):
        cond = F.lit(False)
        for c in cols:
            cond = cond | (row[c] != "")
        return cond
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), some)))


def _links(spark, sf):
    """L7 over the derived page bodies, with the page URL as base."""
    return L.page_links(_pages_snapshot(spark, sf))


def _bases(spark, sf):
    d = _site(spark, sf)
    return W.base_urls(d["domains"], d["store"]), d


# ---------------------------------------------------------------------------
# text functions
# ---------------------------------------------------------------------------

def q_page_text(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", T.page_text(F.col("html")).alias("text"))


def q_unaccent(spark, sf):
    return _texts(spark, sf).select("text_id", T.unaccent(F.col("text")).alias("folded"))


def q_deobfuscate(spark, sf):
    return _texts(spark, sf).select("text_id", T.deobfuscate_email(F.col("text")).alias("decoded"))


def q_digits_only(spark, sf):
    return _texts(spark, sf).select("text_id", T.digits_only(F.col("text")).alias("digits"))


def q_clean_ws(spark, sf):
    return _texts(spark, sf).select("text_id", T.clean_ws(F.col("text")).alias("cleaned"))


def q_siren_plain(spark, sf):
    t = _texts(spark, sf).select("text_id", _joined(E.siren_plain(F.col("text"))).alias("siren"))
    return _nonempty(t, "siren")


def q_siret_plain(spark, sf):
    t = _texts(spark, sf).select("text_id", _joined(E.siret_plain(F.col("text"))).alias("siret"))
    return _nonempty(t, "siret")


def q_email_plain(spark, sf):
    t = _texts(spark, sf).select("text_id", _joined(E.email_plain(F.col("text"))).alias("emails"))
    return _nonempty(t, "emails")


def q_ignore_numbers(spark, sf):
    t = _texts(spark, sf).select(
        "text_id",
        _joined(E.siren_plain(F.col("text"), IGNORED)).alias("siren"),
        _joined(E.siret_plain(F.col("text"), IGNORED)).alias("siret"))
    return _nonempty(t, "siren", "siret")


def q_extract_all_plain(spark, sf):
    t = _texts(spark, sf).select(
        "text_id",
        _joined(E.siren_plain(F.col("text"))).alias("siren"),
        _joined(E.siret_plain(F.col("text"))).alias("siret"),
        _joined(E.email_plain(F.col("text"))).alias("emails"))
    return _nonempty(t, "siren", "siret", "emails")


def q_email_simple(spark, sf):
    t = _texts(spark, sf).select("text_id", _joined(E.email_simple(F.col("text"))).alias("emails"))
    return _nonempty(t, "emails")


def q_email_rfc(spark, sf):
    t = _texts(spark, sf).select("text_id", _joined(E.email_rfc(F.col("text"))).alias("emails"))
    return _nonempty(t, "emails")


def _context_hits(spark, sf, pattern):
    t = _spread_texts(spark, sf)
    t = t.withColumn("_j", T.collapse_ws(F.col("text"))).withColumn("_w", F.split("_j", " ", -1))
    h = t.select("text_id", "_j", "_w", F.explode(E.number_hits(F.col("text"), pattern)).alias("h"))
    return h.select("text_id", F.col("h.pos").cast("bigint").alias("pos"), F.col("h.num").alias("num"),
                    E.context_ok(F.col("_j"), F.col("_w"), F.col("h.pos")).alias("ok"))


def q_context_window(spark, sf):
    return _context_hits(spark, sf, E.K.SIREN_CONTEXT)


def q_siret_context(spark, sf):
    t = E.extract_context(_spread_texts(spark, sf), "text")
    return _nonempty(t.select("text_id", _joined(F.col("siret")).alias("siret")), "siret")


def q_siren_context(spark, sf):
    t = E.extract_context(_spread_texts(spark, sf), "text", drop_siret_prefix=False)
    return _nonempty(t.select("text_id", _joined(F.col("siren")).alias("siren")), "siren")


def q_siren_minus_siret(spark, sf):
    t = E.extract_context(_spread_texts(spark, sf), "text")
    return _nonempty(t.select("text_id", _joined(F.col("siren")).alias("siren"), _joined(F.col("siret")).alias("siret")),
                     "siren", "siret")


def q_extract_page_a(spark, sf):
    r = extract_pages_a(_pages_snapshot(spark, sf))
    return r.select("url", _joined(F.col("siren")).alias("siren"), _joined(F.col("siret")).alias("siret"),
                    _joined(F.col("emails")).alias("emails"))


def q_extract_page_b(spark, sf):
    r = extract_pages_b(_pages_snapshot(spark, sf))
    return r.select("url", _joined(F.col("siren")).alias("siren"), _joined(F.col("siret")).alias("siret"),
                    F.array_join(F.array_sort("emails"), ";").alias("emails"))


# ---------------------------------------------------------------------------
# URL functions and scores
# ---------------------------------------------------------------------------

def q_url_variants(spark, sf):
    return W.variants(_site(spark, sf)["domains"]).select(
        "domain", F.col("variant_rank").cast("bigint").alias("variant_rank"), "url")


def q_base_url(spark, sf):
    b, _ = _bases(spark, sf)
    return b.select("domain", F.coalesce("base_url", F.lit("")).alias("base_url"))


def q_normalize_url(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", U.normalize_url(F.col("url")).alias("norm"))


def _all_urls(spark, sf):
    d = _site(spark, sf)
    return d["snapshot"].select("url").unionByName(d["links"].select(F.col("dst").alias("url"))).distinct()


def q_score_rules(spark, sf):
    return _all_urls(spark, sf).select("url", S.score_rules(F.col("url")).cast("bigint").alias("score"))


def q_score_max(spark, sf):
    ln = _site(spark, sf)["links"]
    return ln.select("src", F.col("pos").cast("bigint").alias("pos"), "dst",
                     F.round(S.score_max(F.col("dst"), F.col("anchor_text")), 6).alias("score"))


def q_score_sum(spark, sf):
    pg = _pages_snapshot(spark, sf)
    return pg.select("url", S.score_sum(F.col("url"), T.page_text(F.col("body"))).alias("score"))


def q_candidates_keyword(spark, sf):
    u = _all_urls(spark, sf)
    return u.filter(U.candidate_keyword(F.col("url")))


def _link_targets(spark, sf):
    ln = _site(spark, sf)["links"]
    return ln.select(F.col("src").alias("domain"), F.col("dst").alias("url"), F.col("pos").cast("bigint").alias("pos"))


def q_candidates_scored(spark, sf):
    r = W.candidates_scored(_link_targets(spark, sf))
    return r.select("domain", "url", F.col("score").cast("bigint").alias("score"), "rank")


def q_candidates_gate(spark, sf):
    r = W.candidates_gate(_link_targets(spark, sf))
    return r.select("domain", "url", F.col("score").cast("bigint").alias("score"), "legal")


def q_url_join(spark, sf):
    ln = _links(spark, sf)
    return ln.select("url", F.col("pos").cast("bigint").alias("pos"), U.url_join(F.col("url"), F.col("href")).alias("link"))


def _pred(spark, sf, fn, name):
    ln = _links(spark, sf).withColumn("link", U.url_join(F.col("url"), F.col("href")))
    return ln.select("url", F.col("pos").cast("bigint").alias("pos"), fn(ln).alias(name))


def q_same_host(spark, sf):
    return _pred(spark, sf, lambda d: U.same_host(F.col("link"), F.col("url")), "same_host")


def q_internal_link(spark, sf):
    return _pred(spark, sf, lambda d: U.internal_link(F.col("link"), F.col("url")), "internal")


def q_skip_scheme(spark, sf):
    return _pred(spark, sf, lambda d: U.skip_scheme(F.col("href")), "skip")


def q_http_only(spark, sf):
    return _pred(spark, sf, lambda d: U.http_only(F.col("link")), "http")


# ---------------------------------------------------------------------------
# links
# ---------------------------------------------------------------------------

def q_page_links(spark, sf):
    ln = _links(spark, sf)
    return ln.select("url", F.col("pos").cast("bigint").alias("pos"), "href", "text",
                     F.coalesce("title", F.lit("")).alias("title"))


def q_keyword_links(spark, sf):
    ln = _links(spark, sf).withColumn("base", F.col("url"))
    r = L.keyword_links(ln, "base")
    return r.select("url", F.col("pos").cast("bigint").alias("pos"), "link")


def q_internal_keyword_links(spark, sf):
    d = _site(spark, sf)
    homes = d["store"].fetch(d["sites"].select(F.col("site").alias("url")))
    ln = L.page_links(homes).withColumn("base", F.col("url"))
    r = L.internal_keyword_links(ln, "base")
    return r.select("url", F.col("pos").cast("bigint").alias("pos"), "link")


def _scoped(spark, sf):
    return L.scoped_links(_pages_snapshot(spark, sf)).withColumn("base", F.col("url"))


def q_footer_links(spark, sf):
    r = L.footer_links_a(_scoped(spark, sf), "base")
    return r.select("url", F.col("pos").cast("bigint").alias("pos"), "link",
                    F.round(S.score_max(F.col("link"), F.col("label")), 6).alias("score"))


def q_legal_links(spark, sf):
    return L.legal_links(_scoped(spark, sf), "base")


def q_footer_links_b(spark, sf):
    r = L.footer_links_b(_scoped(spark, sf), "base")
    return r.select("url", F.col("pos").cast("bigint").alias("pos"), "link")


def q_frame_links(spark, sf):
    r = L.frame_links(_scoped(spark, sf), "base")
    return r.select("url", F.col("pos").cast("bigint").alias("pos"), "link")


def q_clean_text(spark, sf):
    b = _site(spark, sf)["bodies"].select("url", clean_text(F.col("body")).alias("text"))
    return b.select("url", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


# ---------------------------------------------------------------------------
# robots and sitemaps
# ---------------------------------------------------------------------------

def _ok_bases(spark, sf):
    b, d = _bases(spark, sf)
    return b.filter(F.col("base_url").isNotNull()), d


def q_robots_sitemap(spark, sf):
    b, d = _ok_bases(spark, sf)
    return SM.robots_sitemap(b, d["store"], "base_url", "a").select("domain", "sitemap_url")


def q_robots_sitemap_b(spark, sf):
    b, d = _ok_bases(spark, sf)
    return SM.robots_sitemap(b, d["store"], "base_url", "b").select("domain", "sitemap_url")


def _sitemap_mode(spark, sf, mode, robots_mode):
    b, d = _ok_bases(spark, sf)
    starts = SM.robots_sitemap(b, d["store"], "base_url", robots_mode).select("domain", "sitemap_url")
    r = SM.expand_sitemaps(starts, d["store"], mode=mode)
    return rank_within(r, "domain", "ord", "pos", None).select("domain", "url", "pos")


def q_sitemap_a(spark, sf):
    return _sitemap_mode(spark, sf, "a", "a")


def q_sitemap_visited(spark, sf):
    return _sitemap_mode(spark, sf, "b", "b")


def q_sitemap_lenient(spark, sf):
    return _sitemap_mode(spark, sf, "lenient", "b")


# ---------------------------------------------------------------------------
# lookups, choice, top-k, aggregation
# ---------------------------------------------------------------------------

def q_page_lookup(spark, sf):
    d = _site(spark, sf)
    urls = d["links"].select(F.col("dst").alias("url"))
    r = W.page_lookup(urls, d["store"])
    return r.select("url", F.length("body").cast("bigint").alias("n_chars"), F.md5(F.col("body")).alias("md5"))


def q_topk_urls(spark, sf):
    b, d = _ok_bases(spark, sf)
    urls = sitemap_urls_b(b, d["store"]).withColumn("score", S.score_sum(F.col("url")))
    return W.top_urls(urls).select("domain", "url", F.col("slot").cast("bigint").alias("slot"))


def q_rank_links(spark, sf):
    ln = _site(spark, sf)["links"].withColumn("score", S.score_max(F.col("dst"), F.col("anchor_text")))
    from pyspark.sql import Window
    w = Window.partitionBy("site", "dst").orderBy(F.col("score").desc(), "src", "pos")
    first = ln.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    placed = first.withColumn("_place", F.struct((-F.col("score")).alias("s"), "src", "pos"))
    return rank_within(placed, "site", "_place", "rank", None).select(
        "site", F.col("dst").alias("url"), F.round("score", 6).alias("score"), "rank")


def q_domain_union(spark, sf):
    d = _site(spark, sf)
    found = d["bodies"].select(F.col("host").alias("domain"), "url", "body")
    per = extract_pages_a(found.select("url", "body"))
    sets = W.union_per_domain(found.select("domain", "url").join(per, "url"))
    return sets.select("domain", _joined(F.col("siren")).alias("siren"), _joined(F.col("siret")).alias("siret"),
                       _joined(F.col("emails")).alias("emails"))


def _sourced(spark, sf):
    """Bases and page URLs of each domain: its sitemap's, else the crawl's."""
    b, d = _bases(spark, sf)
    b = cut_lineage(b)
    return b, source_urls(b, d["store"])[0]


def q_source_fallback(spark, sf):
    _, urls = _sourced(spark, sf)
    return urls.distinct()


def q_homepage_fallback(spark, sf):
    b, urls = _sourced(spark, sf)
    gated = W.candidates_gate(urls).select("domain", "url").distinct()
    return W.homepage_fallback(b, gated).distinct()


def q_pipeline_a_compat(spark, sf):
    d = _site(spark, sf)
    r = pipeline_a(d["domains"], d["store"], compat=True)
    return r.report


def q_run_stats(spark, sf):
    d = _site(spark, sf)
    return pipeline_a(d["failing"], d["store"]).stats


def q_pipeline_a(spark, sf):
    d = _site(spark, sf)
    return pipeline_a(d["domains"], d["store"]).report


def _seeds(d, bases):
    """Fetched base URLs as ``(site, base)``."""
    ok = bases.join(d["store"].available().select(F.col("url").alias("base_url")), "base_url", "left_semi")
    return cut_lineage(ok.select(F.col("domain").alias("site"), F.col("base_url").alias("base")))


def q_crawl_bfs(spark, sf):
    b, d = _ok_bases(spark, sf)
    seeds = _seeds(d, b)
    homes = d["store"].fetch(seeds.select(F.col("base").alias("url")))
    scoped = L.scoped_links(homes).join(seeds.select(F.col("base").alias("url"), "site", "base"), "url")
    footer = L.footer_links_a(scoped, "base").select("site", "link", "text", "label", "pos")
    r = C.crawl_bfs(seeds, C.links_of(d["store"], L.page_links), footer)
    return r.select("site", "url", F.round("score", 6).alias("score"), F.col("depth").cast("bigint").alias("depth"), "rank")


def q_crawl_scored(spark, sf):
    b, d = _ok_bases(spark, sf)
    r = C.crawl_scored(_seeds(d, b), d["store"], L.page_links)
    return r.select("site", "url", F.round("score", 6).alias("score"), F.col("depth").cast("bigint").alias("depth"))


def _bases_b(spark, sf):
    d = _site(spark, sf)
    return W.base_urls(d["domains"], d["store_b"], d["redirects"]), d


def q_base_url_b(spark, sf):
    b, _ = _bases_b(spark, sf)
    return b.select("domain", F.coalesce("base_url", F.lit("")).alias("base_url"))


def q_page_lookup_fallback(spark, sf):
    d = _site(spark, sf)
    urls = d["links"].select(F.col("dst").alias("url")).unionByName(d["sites"].select(F.col("site").alias("url")))
    r = W.page_lookup(urls, d["store_b"]).join(d["store_b"].choose(urls).select("url", "source"), "url")
    return r.select("url", F.col("source").cast("bigint").alias("source"), F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("md5"))


def q_crawl_site(spark, sf):
    b, d = _bases_b(spark, sf)
    seeds = b.filter(F.col("base_url").isNotNull()).select(F.col("domain").alias("site"), F.col("base_url").alias("base"))
    return C.crawl_site(cut_lineage(seeds), C.links_of(d["store_b"], L.scoped_links, rendered=True))


def _pipeline_b(spark, sf, **how):
    d = _site(spark, sf)
    return pipeline_b(d["domains"], d["store_b"], redirects=d["redirects"], **how)


def q_pipeline_b(spark, sf):
    return _pipeline_b(spark, sf, keep_partial=True).report


def q_domain_report_b(spark, sf):
    return _pipeline_b(spark, sf).report


def _raw_domain_values(spark, sf):
    """Domain-list cells derived from page hosts: blank, padded, upper-cased,
    URL-shaped and plain values (duplicates kept)."""
    p = read_table(spark, sf, "pages").select("page_id", U.netloc(F.col("url")).alias("host"))
    k = F.col("page_id") % 5
    cell = (F.when(k == 0, F.lit(""))
            .when(k == 1, F.concat(F.lit("  "), F.col("host"), F.lit(" ")))
            .when(k == 2, F.upper(F.col("host")))
            .when(k == 3, F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
            .otherwise(F.col("host")))
    return p.select("page_id", cell.alias("domain"))


def q_src_domains_a(spark, sf):
    from crawlfold.sources.tables import domains_a
    return domains_a(_raw_domain_values(spark, sf)).select("page_id", "domain")


def q_src_domains_b(spark, sf):
    from crawlfold.sources.tables import domains_b
    return domains_b(_raw_domain_values(spark, sf)).select("page_id", "domain")


def q_domain_report_a(spark, sf):
    """A list of domains as CSV files, read in order, through pipeline A, written
    as CSV in input order, and read again."""
    d = _site(spark, sf)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-a-{uuid.uuid4().hex}"
    cells = _raw_domain_values(spark, sf).withColumnRenamed("page_id", "input_pos")
    write_ordered_csv(cells, f"{base}/in", files=4)
    domains = read_domain_csv(spark, f"{base}/in")
    write_report_a(domains, pipeline_a(domains, d["store"]).cells, f"{base}/out")
    return read_ordered_csv(spark, f"{base}/out").na.fill("")


def q_domain_status(spark, sf):
    b, _ = _bases(spark, sf)
    ok = F.col("base_url").isNotNull()
    return b.select("domain", F.when(ok, F.lit("success")).otherwise(F.lit("error")).alias("status"),
                    F.when(ok, F.lit("")).otherwise(F.lit(E.K.ERROR_NO_BASE_URL)).alias("error_reason"))


def q_legal_pages(spark, sf):
    _, urls = _sourced(spark, sf)
    g = W.candidates_gate(urls).filter("legal")
    return g.groupBy("domain").agg(F.count(F.lit(1)).cast("bigint").alias("legal_pages"))


def q_error_rate(spark, sf):
    return q_run_stats(spark, sf).select("total_requests", "error_rate")


def q_cascade(spark, sf):
    sets = _pipeline_b(spark, sf).sets
    return sets.select("domain", _joined(F.col("siren")).alias("siren"), _joined(F.col("siret")).alias("siret"),
                       _joined(F.col("emails")).alias("emails"))



# ---------------------------------------------------------------------------
# contract
# ---------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "page_text": q_page_text,
    "unaccent": q_unaccent,
    "deobfuscate": q_deobfuscate,
    "digits_only": q_digits_only,
    "clean_ws": q_clean_ws,
    "siren_plain": q_siren_plain,
    "siret_plain": q_siret_plain,
    "email_plain": q_email_plain,
    "ignore_numbers": q_ignore_numbers,
    "extract_all_plain": q_extract_all_plain,
    "email_simple": q_email_simple,
    "email_rfc": q_email_rfc,
    "context_window": q_context_window,
    "siret_context": q_siret_context,
    "siren_context": q_siren_context,
    "siren_minus_siret": q_siren_minus_siret,
    "extract_page_a": q_extract_page_a,
    "extract_page_b": q_extract_page_b,
    "url_variants": q_url_variants,
    "base_url": q_base_url,
    "normalize_url": q_normalize_url,
    "score_rules": q_score_rules,
    "score_max": q_score_max,
    "score_sum": q_score_sum,
    "candidates_keyword": q_candidates_keyword,
    "candidates_scored": q_candidates_scored,
    "candidates_gate": q_candidates_gate,
    "url_join": q_url_join,
    "same_host": q_same_host,
    "internal_link": q_internal_link,
    "skip_scheme": q_skip_scheme,
    "http_only": q_http_only,
    "page_links": q_page_links,
    "keyword_links": q_keyword_links,
    "internal_keyword_links": q_internal_keyword_links,
    "footer_links": q_footer_links,
    "legal_links": q_legal_links,
    "footer_links_b": q_footer_links_b,
    "frame_links": q_frame_links,
    "clean_text": q_clean_text,
    "robots_sitemap": q_robots_sitemap,
    "robots_sitemap_b": q_robots_sitemap_b,
    "sitemap_a": q_sitemap_a,
    "sitemap_visited": q_sitemap_visited,
    "sitemap_lenient": q_sitemap_lenient,
    "page_lookup": q_page_lookup,
    "topk_urls": q_topk_urls,
    "rank_links": q_rank_links,
    "domain_union": q_domain_union,
    "source_fallback": q_source_fallback,
    "homepage_fallback": q_homepage_fallback,
    "pipeline_a_compat": q_pipeline_a_compat,
    "run_stats": q_run_stats,
    "pipeline_a": q_pipeline_a,
    "crawl_bfs": q_crawl_bfs,
    "crawl_scored": q_crawl_scored,
    "crawl_site": q_crawl_site,
    "base_url_b": q_base_url_b,
    "page_lookup_fallback": q_page_lookup_fallback,
    "pipeline_b": q_pipeline_b,
    "domain_report_b": q_domain_report_b,
    "src_domains_a": q_src_domains_a,
    "src_domains_b": q_src_domains_b,
    "domain_status": q_domain_status,
    "legal_pages": q_legal_pages,
    "error_rate": q_error_rate,
    "domain_report_a": q_domain_report_a,
    "cascade": q_cascade,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: pipeline A report over the derived sf0.001 site snapshot."""
    return q_pipeline_a(spark, SF_SMOKE)


try:  # the training-data operators are a package of their own, which may be absent
    from crawlfold.llm.registry import ORACLE_SQL as _LLM_SQL  # noqa: E402
    from crawlfold.llm.registry import QUERIES as _LLM_QUERIES  # noqa: E402
    from corpus_pipeline import ORACLE_SQL as _PIPELINE_SQL  # noqa: E402
    from corpus_pipeline import run as _pipeline  # noqa: E402
except ImportError:
    _LLM_QUERIES, _LLM_SQL = {}, {}
else:
    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": _pipeline}
    if _PIPELINE_SQL:
        _LLM_SQL = {**_LLM_SQL, "pipeline": _PIPELINE_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    from oracle_sql import build_oracle_sql

    out = build_oracle_sql()
    return {k: v for k, v in out.items() if k in _QUERIES} | _LLM_SQL
