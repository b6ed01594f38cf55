"""Inputs derived from the driver tables (same rules in the DuckDB oracle).

The driver's ``pages`` hold no identifiers, no link between pages and no
robots or sitemap files, so a site snapshot is derived from them:

* ``id_text``   per supplier: ``Mentions legales SIRET ddd 552 081 ddddd
  Contact: c<key>@exemple.fr``;
* ``texts``     ``documents`` texts plus the supplier texts (ids -1 - key);
* page rank     0-based rank of a page inside its host by ``page_id``;
* ``links``     page of rank r links to ranks (r+1)%n, (2r+1)%n, (3r+2)%n of
  its host (self links dropped), anchor texts by position, and (position 3)
  to the host's legal notice page ``scheme://host/mentions-legales``;
* snapshot      each page body gets a supplier paragraph (page id modulo 3: with
  a numeric reference, named ones after a keywords ``meta``, or a SIREN of its
  own and the paragraph marked by class and id), a frame of the legal notice
  (page id modulo 7 is 3) and its links (in a ``div class="site-footer"`` when
  the host name has even length, else in ``<main>``); every host gets a homepage ``scheme://host`` (its rank-0 body),
  a legal notice page (supplier ``length(host) * 7 % n`` text) and a
  ``robots.txt``; hosts whose name length is not a multiple of 3 get a
  sitemap index (advertised in robots.txt as ``/sitemap_index.xml`` for even
  lengths, else at the default ``/sitemap.xml``) over url sets of at most
  ``SITEMAP_CHUNK`` URLs (``&`` written ``&amp;``, locs sorted; the legal
  page is listed in chunk 0);
* ``domains``   the hosts plus ``missing.example.net`` (no snapshot row);
* static_b, rendered   the same pages as a fetch without and with a browser
  sees them: of hosts whose name length is a multiple of 5 (dark ones) the
  static homepage is an empty shell, all other pages are missing, and the
  rendered snapshot has the homepage; elsewhere pages of an id that is 5 modulo 11
  are missing in the static and present in the rendered snapshot;
* redirects     ``https://www.<host>`` leads to the site in one hop (name length
  modulo 4 is 1) or two over ``http://www.<host>`` (2); for 3 the two lead to
  each other;
* failing       domains whose name length modulo 9 is 1 fail while they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.functions.keywords import SITEMAP_NS
from crawlfold.functions.urls import netloc, scheme
from crawlfold.operators.ranking import rank_within
from crawlfold.session import cut_lineage, width
from crawlfold.sources.store import PageStore, url_index
from crawlfold.sources.tables import read_table

_MEMO: dict[tuple[str, str], dict[str, DataFrame]] = {}

# ---------------------------------------------------------------------------
# FIXED VALUES (derived fixture rules, shared with the oracle SQL)
# ---------------------------------------------------------------------------
SITEMAP_CHUNK = 50000
ANCHOR_TEXTS = ["Suivant", "Contact", "Plan du site", "Mentions légales"]
LEGAL_PATH = "/mentions-legales"
MISSING_DOMAIN = "missing.example.net"
KEYWORDS_META = '<meta name="keywords" content="siret &amp; siren">'
SHELL = '<html><body><div id="app"></div><script src="/app.js"></script></body></html>'
FAILURE = "Connection reset by peer"
MARKED_PARAGRAPH = '<p id="contact" class="mentions">'
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def id_text(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("Mentions legales SIRET "),
        F.lpad((k % 1000).cast("string"), 3, "0"),
        F.lit(" 552 081 "),
        F.lpad(((k * 37) % 100000).cast("string"), 5, "0"),
        F.lit(" Contact: c"),
        k.cast("string"),
        F.lit("@exemple.fr"),
    )
    return supplier.select(k.alias("s_suppkey"), text.alias("text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text_id, text)``: every document plus every supplier text."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    sup = id_text(read_table(spark, sf_dir, "supplier")).select((-F.col("s_suppkey") - 1).alias("text_id"), "text")
    return docs.unionByName(sup)


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, host, scheme, rank, group_size)`` (no html)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    keyed = pages.select("page_id", "url", netloc("url").alias("host"), scheme("url").alias("scheme"))
    return rank_within(keyed, "host", "page_id", "rank", "group_size")


def sites(ranked: DataFrame) -> DataFrame:
    """One row per host: site root and file layout flags."""
    root = ranked.filter(F.col("rank") == 0).select(
        "host", F.concat("scheme", F.lit("://"), "host").alias("site"), "group_size")
    hl = F.length("host")
    return root.select(
        "host", "site", "group_size",
        (hl % 3 != 0).alias("has_sitemap"),
        (hl % 2 == 0).alias("advertised"),
    )


def links(ranked: DataFrame) -> DataFrame:
    """``(site, src, dst, pos, anchor_text)`` of the derived link graph."""
    r, n = F.col("rank"), F.col("group_size")
    targets = F.array(((r + 1) % n), ((2 * r + 1) % n), ((3 * r + 2) % n))
    src = ranked.select("host", "url", "rank", F.posexplode(targets).alias("pos", "trank"))
    src = src.filter(F.col("trank") != F.col("rank"))
    dst = ranked.select("host", F.col("rank").alias("trank"), F.col("url").alias("dst"))
    anchors = F.element_at(F.array(*[F.lit(a) for a in ANCHOR_TEXTS]), (F.col("pos") + 1).cast("int"))
    ranked_links = src.join(dst, ["host", "trank"]).select(
        F.col("host").alias("site"), F.col("url").alias("src"), "dst", F.col("pos").cast("int").alias("pos"),
        anchors.alias("anchor_text"))
    legal = ranked.join(sites(ranked).select("host", "site"), "host").select(
        F.col("host").alias("site"), F.col("url").alias("src"), F.concat("site", F.lit(LEGAL_PATH)).alias("dst"),
        F.lit(3).alias("pos"), F.lit(ANCHOR_TEXTS[3]).alias("anchor_text"))
    return ranked_links.unionByName(legal)


def _paragraph() -> F.Column:
    """A page's supplier text as HTML: by page id, the address has a numeric
    reference, or names stand before it, or a SIREN of its own follows."""
    own = F.lpad(((F.col("s_suppkey") * 13) % 1000).cast("string"), 3, "0")
    k = F.col("page_id") % 3
    return (F.when(k == 0, F.concat(F.lit("<p>"), F.replace(F.col("text"), F.lit("@"), F.lit("&#64;")), F.lit("</p>")))
            .when(k == 1, F.concat(F.lit(KEYWORDS_META + "<p>N&deg; t&ecirc;te&rsquo; "), F.col("text"), F.lit("</p>")))
            .otherwise(F.concat(F.lit(MARKED_PARAGRAPH), F.col("text"), F.lit(" SIREN "), own, F.lit(" 443 210.</p>"))))


def _frame() -> F.Column:
    return F.when(F.col("page_id") % 7 == 3, F.lit(f'<iframe src="{LEGAL_PATH}"></iframe>')).otherwise(F.lit(""))


def _page_bodies(spark: SparkSession, sf_dir: str, ranked: DataFrame, link_df: DataFrame) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    supplier = read_table(spark, sf_dir, "supplier")
    n_sup = supplier.agg(F.count(F.lit(1)).alias("n_sup"))          # one row
    ids = id_text(supplier)
    a_tags = link_df.select(
        "src", "pos",
        F.concat(F.lit('<a href="'), F.col("dst"), F.lit('">'), F.col("anchor_text"), F.lit("</a>")).alias("a"))
    # at most three links per page: a bounded group
    blocks = a_tags.groupBy("src").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]), "").alias("anchors"))
    even = F.length("host") % 2 == 0
    body = (
        ranked.join(pages, "page_id")
        .crossJoin(F.broadcast(n_sup))
        .withColumn("s_suppkey", F.col("page_id") % F.col("n_sup"))
        .join(ids, "s_suppkey")
        .join(blocks, F.col("url") == F.col("src"), "left")
        .withColumn("anchors", F.coalesce("anchors", F.lit("")))
        .withColumn(
            "body",
            F.concat(
                F.col("html"), _frame(), _paragraph(),
                F.when(even, F.concat(F.lit('<div class="site-footer">'), F.col("anchors"), F.lit("</div>")))
                .otherwise(F.concat(F.lit("<main>"), F.col("anchors"), F.lit("</main>"))),
            ),
        )
    )
    return body.select("page_id", "url", "host", "rank", "body")


def _sitemap_files(ranked: DataFrame, site_df: DataFrame) -> DataFrame:
    with_site = ranked.join(site_df.filter("has_sitemap"), "host")
    chunk = F.floor(F.col("rank") / SITEMAP_CHUNK).cast("bigint")
    locs = with_site.select(
        "host", "site", chunk.alias("chunk"),
        F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("e"),
        F.col("url").alias("u"))
    legal_url = F.concat("site", F.lit(LEGAL_PATH))
    locs = locs.unionByName(site_df.filter("has_sitemap").select(
        "host", "site", F.lit(0).cast("bigint").alias("chunk"),
        F.concat(F.lit("<url><loc>"), legal_url, F.lit("</loc></url>")).alias("e"), legal_url.alias("u")))
    # one url set per (host, chunk): at most SITEMAP_CHUNK entries each
    urlsets = locs.groupBy("host", "site", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "e"))), lambda x: x["e"]), "").alias("entries"))
    urlsets = urlsets.select(
        "host", "site", "chunk",
        F.concat(F.col("site"), F.lit("/sitemap-"), F.col("chunk").cast("string"), F.lit(".xml")).alias("url"),
        F.concat(F.lit(XML_HEAD + f'<urlset xmlns="{SITEMAP_NS}">'), F.col("entries"), F.lit("</urlset>")).alias("body"))
    index_entries = urlsets.groupBy("host", "site").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "url"))),
                                 lambda x: F.concat(F.lit("<sitemap><loc>"), x["url"], F.lit("</loc></sitemap>"))), "").alias("entries"))
    indexes = index_entries.join(site_df.select("host", "advertised"), "host").select(
        F.concat(F.col("site"), F.when(F.col("advertised"), F.lit("/sitemap_index.xml")).otherwise(F.lit("/sitemap.xml"))).alias("url"),
        F.concat(F.lit(XML_HEAD + f'<sitemapindex xmlns="{SITEMAP_NS}">'), F.col("entries"), F.lit("</sitemapindex>")).alias("body"))
    return urlsets.select("url", "body").unionByName(indexes)


def robots(site_df: DataFrame) -> DataFrame:
    body = F.when(
        F.col("has_sitemap") & F.col("advertised"),
        F.concat(F.lit("User-agent: *\nDisallow:\nSitemap: "), F.col("site"), F.lit("/sitemap_index.xml\n")),
    ).otherwise(F.lit("User-agent: *\nDisallow:\n"))
    return site_df.select(F.concat(F.col("site"), F.lit("/robots.txt")).alias("url"), body.alias("body"))


def redirects(site_df: DataFrame) -> DataFrame:
    """``(url, location)`` of the derived redirects."""
    n = F.length("host") % 4
    first, second = F.concat(F.lit("https://www."), "host"), F.concat(F.lit("http://www."), "host")
    hop = lambda url, to: F.struct(url.alias("url"), to.alias("location"))
    site = F.col("site")
    hops = (F.when(n == 1, F.array(hop(first, site))).when(n == 2, F.array(hop(first, second), hop(second, site)))
            .when(n == 3, F.array(hop(first, second), hop(second, first))))
    return site_df.select(F.explode(hops).alias("r")).select("r.*")


class _Tables(dict):
    """Tables by name; what is given as a function is made when it is first asked for."""

    def __getitem__(self, name: str):
        if callable(made := super().__getitem__(name)):
            self[name] = made = made()
        return made


def site_snapshot(spark: SparkSession, sf_dir: str, materialize: bool = True) -> dict[str, DataFrame]:
    """All derived site tables: ``snapshot`` (url, body, kind), ``links``,
    ``sites``, ``domains``, ``failing``, ``redirects``, ``ranked``, ``bodies``, and
    the page stores ``store`` and ``store_b`` with their url indexes.

    With ``materialize`` (default) the tables are written once per session
    and input folder as reliable checkpoints (the shared checkpoint folder)
    and reused, as a stored snapshot table would be; pipeline B's (``redirects``
    and ``store_b``) when a query first asks for them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if materialize and key in _MEMO:
        return _MEMO[key]
    keep = cut_lineage if materialize else (lambda df: df)
    ranked = keep(ranked_pages(spark, sf_dir))
    site_df = keep(sites(ranked))
    link_df = keep(links(ranked))
    # the pages are parsed again and again: as many files as tasks can read at once
    bodies = keep(_page_bodies(spark, sf_dir, ranked, link_df).repartition(width(spark)))
    homepages = bodies.filter(F.col("rank") == 0).join(site_df.select("host", "site"), "host").select(
        "host", F.col("site").alias("url"), "body")
    supplier = read_table(spark, sf_dir, "supplier")
    n_sup = supplier.agg(F.count(F.lit(1)).alias("n_sup"))
    legal_pages = (
        site_df.crossJoin(F.broadcast(n_sup))
        .withColumn("s_suppkey", (F.length("host") * 7) % F.col("n_sup"))
        .join(id_text(supplier), "s_suppkey")
        .select("host", F.concat("site", F.lit(LEGAL_PATH)).alias("url"),
                F.concat(F.lit("<html><body><h1>Mentions légales</h1><p>"), F.col("text"),
                         F.lit("</p></body></html>")).alias("body"))
    )
    page, no = F.lit("page").alias("kind"), F.lit(False)
    pages = (bodies.select("host", "url", "body", (F.col("page_id") % 11 == 5).alias("script"), no.alias("home"))
             .unionByName(homepages.select("host", "url", "body", no.alias("script"), F.lit(True).alias("home")))
             .unionByName(legal_pages.select("host", "url", "body", no.alias("script"), no.alias("home"))))
    files = robots(site_df).withColumn("kind", F.lit("robots")).unionByName(
        _sitemap_files(ranked, site_df).withColumn("kind", F.lit("sitemap")))
    by_kind = (lambda df: cut_lineage(df, ("kind",))) if materialize else (lambda df: df)
    snapshot = by_kind(pages.select("url", "body", page).unionByName(files))
    dark = F.length("host") % 5 == 0
    seen = F.when(dark & F.col("home"), F.lit(SHELL)).when(dark | F.col("script"), F.lit("")).otherwise(F.col("body"))

    def store_b() -> PageStore:
        static = by_kind(pages.select("url", seen.alias("body"), page).unionByName(files))
        rendered = keep(pages.filter((F.col("script") & ~dark) | (dark & F.col("home"))).select("url", "body"))
        return PageStore(static, rendered, keep(url_index(static, rendered)))

    domains = site_df.select(F.col("host").alias("domain")).unionByName(
        spark.range(1).select(F.lit(MISSING_DOMAIN).alias("domain")))
    domains = keep(domains)
    failing = domains.withColumn("error", F.when(F.length("domain") % 9 == 1, F.lit(FAILURE)))
    out = _Tables({"snapshot": snapshot, "links": link_df, "sites": site_df, "domains": domains, "ranked": ranked, "bodies": bodies,
                   "failing": failing, "redirects": lambda: keep(redirects(site_df)),
                   "store": PageStore(snapshot, None, keep(url_index(snapshot))), "store_b": store_b})
    if materialize:
        _MEMO[key] = out
    return out
