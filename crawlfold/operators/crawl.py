"""Breadth-first crawls as level-synchronous joins.

A FIFO crawl visits level d before level d+1 and, inside a level, parents in
queue order and links in document order. So one level is one relational
step:

1. take the links of the frontier's pages: ``links`` is a function from a table
   of urls to their links, so a level reads and parses only the pages it needs
   (a left-semi join of the snapshot to the written, hence sized, frontier);
2. resolve, filter, left-anti the visited set, keep the first sighting of
   each URL by ``(parent rank, link position)``;
3. the visited count seen when parent ``p`` is popped is the count before
   the level plus the new URLs first seen at earlier parents (a running sum
   over parents); parents at or past the cap are not expanded;
4. survivors are ranked for the next level; state is checkpointed.

Per site, rows per level are bounded by the visit cap times the links of a
page, so the per-site windows stay small even for a site with a third of
all pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.scoring import score_max, score_sum
from crawlfold.functions.urls import contains_any, http_only, netloc, strip_ws, url_join
from crawlfold.session import cut_lineage
from crawlfold.sources.store import PageStore, store_of

Links = DataFrame | Callable[[DataFrame], DataFrame]


def links_of(pages: PageStore | DataFrame, extract: Callable[[DataFrame], DataFrame], rendered: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Links of some urls only: ``extract`` runs on the pages of the urls asked for."""
    store = store_of(pages)
    return lambda urls: extract(store.fetch(urls, rendered=rendered))


def _links(links: Links, frontier: DataFrame) -> DataFrame:
    return links(frontier) if callable(links) else links


def _rank_next(df: DataFrame, order_cols) -> DataFrame:
    w = Window.partitionBy("site").orderBy(*order_cols)
    return df.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def _label(links: DataFrame) -> F.Column:
    """What a link is scored by: its glued label, or else its stripped text."""
    return F.col("label") if "label" in links.columns else strip_ws(F.col("text"))


def crawl_bfs(seeds: DataFrame, links: Links, footer: DataFrame | None = None,
              max_depth: int = K.CRAWL_MAX_DEPTH, cap: int = K.CRAWL_MAX_VISITED) -> DataFrame:
    """Scored BFS over internal links (pipeline A).

    seeds  ``(site, base)``: start pages that were fetched;
    links  ``(url, pos, href, text)``: anchors of the fetched pages, as a table
           or as a function of the urls needed (``links_of``);
    footer ``(site, link, text, pos)``: footer links of the start page
           (already resolved, same host), scored and marked visited first,
           never expanded.

    Returns ``(site, url, score, depth, rank)``: distinct URLs, best first
    (score descending, then discovery order).
    """
    seeds = seeds.select("site", "base")
    if footer is None:
        footer = seeds.limit(0).select("site", F.lit("").alias("link"), F.lit("").alias("text"), F.lit(0).alias("pos"))
    fl = cut_lineage(footer.select(
        "site", F.col("link").alias("url"), score_max(F.col("link"), _label(footer)).alias("score"),
        F.lit(0).alias("depth"), "pos"))
    w_f = Window.partitionBy("site").orderBy(F.col("score").desc(), "pos")
    found = fl.withColumn("ord", F.array(F.lit(0), (F.row_number().over(w_f)).cast("bigint"))).drop("pos")

    visited = fl.select("site", "url").unionByName(seeds.select("site", F.col("base").alias("url"))).distinct()
    counts = visited.groupBy("site").agg(F.count(F.lit(1)).alias("n_visited"))
    frontier = seeds.select("site", "base", F.col("base").alias("url"), F.lit(0).cast("bigint").alias("rank"))
    found_parts = [found]
    for depth in range(max_depth):
        out = _links(links, frontier)
        e = frontier.join(out.select("url", "pos", "href", _label(out).alias("label")), "url")
        e = e.select("site", "base", F.col("rank").alias("parent_rank"), "pos", "href", "label",
                     url_join(F.col("base"), F.col("href")).alias("abs"))
        skip = F.lit(False)
        for p in K.SKIP_HREF_PREFIXES_C1:
            skip = skip | F.col("href").startswith(p)
        e = e.filter((netloc(F.col("abs")) == netloc(F.col("base"))) & ~skip)
        e = e.join(visited.withColumnRenamed("url", "abs"), ["site", "abs"], "left_anti")
        w_first = Window.partitionBy("site", "abs").orderBy("parent_rank", "pos")
        e = e.withColumn("_k", F.row_number().over(w_first)).filter("_k = 1").drop("_k")
        w_run = Window.partitionBy("site").orderBy("parent_rank").rangeBetween(Window.unboundedPreceding, -1)
        e = e.withColumn("_before", F.count(F.lit(1)).over(w_run)).join(counts, "site", "left").filter(
            F.coalesce("n_visited", F.lit(0)) + F.col("_before") < cap).drop("_before", "n_visited")
        # one table per level; visited set, counts and the next frontier are read
        # from these, so their lineage stays short
        kept = cut_lineage(e)
        visited = visited.unionByName(kept.select("site", F.col("abs").alias("url")))
        counts = visited.groupBy("site").agg(F.count(F.lit(1)).alias("n_visited"))
        scored = kept.withColumn("score", score_max(F.col("abs"), F.col("label"))).filter(F.col("score") > 0)
        found_parts.append(scored.select(
            "site", F.col("abs").alias("url"), "score", F.lit(depth + 1).alias("depth"),
            F.array(F.lit(1), F.lit(depth).cast("bigint"), F.col("parent_rank"), F.col("pos").cast("bigint")).alias("ord")))
        nxt = _rank_next(scored.select("site", "base", F.col("abs").alias("url"), "parent_rank", "pos"),
                         ["parent_rank", "pos"])
        if depth + 1 == max_depth or kept.isEmpty():
            break
        frontier = nxt.select("site", "base", "url", "rank")
    allf = found_parts[0]
    for p in found_parts[1:]:
        allf = allf.unionByName(p)
    w_u = Window.partitionBy("site", "url").orderBy(F.col("score").desc(), "ord")
    uniq = allf.withColumn("_k", F.row_number().over(w_u)).filter("_k = 1").drop("_k")
    w_r = Window.partitionBy("site").orderBy(F.col("score").desc(), "ord")
    return uniq.withColumn("rank", (F.row_number().over(w_r) - 1).cast("bigint")).drop("ord")


def crawl_site(seeds: DataFrame, scoped: Links, max_depth: int = K.SITE_CRAWL_MAX_DEPTH,
               max_pages: int = K.SITE_CRAWL_MAX_PAGES) -> DataFrame:
    """FIFO crawl of pipeline B: footer links (footer/bottom/bas-page) and
    keyword-text links are collected and queued, frames collected only;
    off-site http(s) links allowed; at most ``max_pages`` pages processed.

    seeds  ``(site, base)``; scoped ``(url, pos, href, text, in_footer_b,
    is_frame)`` of the fetched pages (static or rendered), as a table or as a
    function of the urls needed (``links_of``).
    Returns ``(site, url)``: the distinct collected URLs.
    """
    frontier = seeds.select("site", "base", F.col("base").alias("url"),
                            F.array().cast("array<bigint>").alias("qord"))
    visited = seeds.limit(0).select("site", F.lit("").alias("url"))
    processed = seeds.select("site").distinct().withColumn("n_done", F.lit(0).cast("bigint"))
    found_parts = []
    for depth in range(max_depth + 1):
        q = frontier.join(visited, ["site", "url"], "left_anti")
        w_first = Window.partitionBy("site", "url").orderBy("qord")
        q = q.withColumn("_k", F.row_number().over(w_first)).filter("_k = 1").drop("_k")
        q = q.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy("qord")) - 1)
        q = q.join(processed, "site").filter(F.col("_r") < max_pages - F.col("n_done"))
        q = cut_lineage(q.select("site", "base", "url", F.col("_r").cast("bigint").alias("parent_rank")))
        if q.isEmpty() and found_parts:
            break
        visited = visited.unionByName(q.select("site", "url"))
        processed = (
            processed.join(q.groupBy("site").agg(F.count(F.lit(1)).alias("_c")), "site", "left")
            .select("site", (F.col("n_done") + F.coalesce("_c", F.lit(0))).alias("n_done")))
        links = _links(scoped, q).select("url", "pos", "href", "text", "in_footer_b", "is_frame")
        links = links.filter(~F.col("is_frame") | (F.col("href") != ""))  # a frame without a source leads nowhere
        e = q.join(links, "url").withColumn("link", url_join(F.col("base"), F.col("href")))
        e = cut_lineage(e.filter(http_only(F.col("link"))).drop("href"))  # read twice: results and next frontier
        footer = e.filter(F.col("in_footer_b") & ~F.col("is_frame"))
        regular = e.filter(contains_any(F.lower(F.col("text")), K.CANDIDATE_KEYWORDS) & ~F.col("is_frame"))
        frames = e.filter(F.col("is_frame"))
        found_parts.append(footer.select("site", F.col("link").alias("url"))
                           .unionByName(regular.select("site", F.col("link").alias("url")))
                           .unionByName(frames.select("site", F.col("link").alias("url"))))
        if depth >= max_depth:
            break
        nxt = (footer.select("site", "base", F.col("link").alias("url"),
                             F.array(F.col("parent_rank"), F.lit(0).cast("bigint"), F.col("pos").cast("bigint")).alias("qord"))
               .unionByName(regular.select("site", "base", F.col("link").alias("url"),
                                           F.array(F.col("parent_rank"), F.lit(1).cast("bigint"), F.col("pos").cast("bigint")).alias("qord"))))
        frontier = nxt
    out = found_parts[0]
    for p in found_parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def crawl_scored(seeds: DataFrame, pages: PageStore | DataFrame, extract: Callable[[DataFrame], DataFrame],
                 max_found: int = K.PAGE_CRAWL_MAX_FOUND, min_score: float = K.PAGE_CRAWL_MIN_SCORE) -> DataFrame:
    """Crawl of a site's own pages that keeps those whose URL and source text
    score over ``min_score``, until ``max_found`` are kept. Any order is fine for
    the set that such a crawl reads from; here pages come by (depth, url), so that
    results do not depend on chance.

    seeds    ``(site, base)``; links are resolved against ``base`` and stay on its host;
    extract  anchors ``(url, href)`` of pages ``(url, body)``.

    A level is read at once. Where it holds the last page that a site may keep,
    the level is cut behind that page: found by a top-k of the kept urls, not by
    a running count over the site. Pages that cannot be read count as visited.
    Returns ``(site, url, score, depth)``.
    """
    store = store_of(pages)
    frontier = cut_lineage(seeds.select("site", "base", F.col("base").alias("url")))
    visited, found, depth = frontier.select("site", "url"), [], 0
    counts = seeds.select("site", F.lit(0).cast("bigint").alias("n"))
    while True:
        bodies = store.fetch(frontier)
        level = frontier.join(bodies, "url").select("site", "base", "url", score_sum(F.col("url"), F.col("body")).alias("score"))
        level = cut_lineage(level.join(counts, "site"))
        kept = level.filter(F.col("score") > min_score)
        first = kept.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("url"))).filter(F.col("_k") <= max_found)
        last = first.filter(F.col("_k") + F.col("n") == max_found).select("site", F.col("url").alias("_last"))
        opened = cut_lineage(level.join(last, "site", "left").filter(F.col("_last").isNull() | (F.col("url") <= F.col("_last"))))
        new = opened.filter(F.col("score") > min_score)
        found.append(new.select("site", "url", "score", F.lit(depth).alias("depth")))
        counts = cut_lineage(counts.join(new.groupBy("site").agg(F.count(F.lit(1)).alias("_new")), "site", "left").select(
            "site", (F.col("n") + F.coalesce("_new", F.lit(0))).alias("n")))
        more = opened.join(counts.filter(F.col("n") < max_found).select("site"), "site", "left_semi")
        edges = more.join(extract(store.fetch(more)).select("url", "href"), "url")
        links = edges.select("site", "base", url_join(F.col("base"), F.col("href")).alias("url"))
        links = links.filter(netloc(F.col("url")) == netloc(F.col("base"))).distinct()
        frontier = cut_lineage(links.join(visited, ["site", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("site", "url"))
        depth += 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
