"""robots.txt and sitemap operators over a snapshot.

Sitemaps are parsed with ``from_xml`` after the prolog (byte order mark,
processing instructions, comments, DOCTYPE) and namespace prefixes are stripped
(a prefixed ``<s:urlset>`` otherwise reads as NULL); a document must carry
the sitemap namespace URI, as namespaced lookups require. Index files are
expanded level by level until no sitemap is left that its domain has not seen
yet (so any depth is read and a cycle ends): the frontier of child sitemap URLs
is joined to the snapshot, and each level's parsed documents are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.text import let
from crawlfold.functions.urls import origin, strip_ws, url_join
from crawlfold.session import cut_lineage, width
from crawlfold.sources.store import PageStore, store_of

SITEMAP_SCHEMA = "url ARRAY<STRUCT<loc: STRING>>, sitemap ARRAY<STRUCT<loc: STRING>>, _corrupt_record STRING"
PREFIX_RE = r"<(/?)[A-Za-z_][\w.-]*:"
PROLOG_RE = r"(?i)^(?:\s++|\x{FEFF}|<\?(?s:.*?)\?>|<!--(?s:.*?)-->|<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\])?[^>]*+>)*+"
ROOT_RE = r"^<([A-Za-z_][\w.:-]*)"
LINE_SPLIT_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
BARE_URL_RE = r"""https?://[^\s<>"]+(?<![.,])"""


def robots_url(base) -> F.Column:
    return F.concat(origin(base), F.lit("/robots.txt"))


def sitemap_line(body) -> F.Column:
    """Value of the first ``sitemap:`` line (case-insensitive), stripped;
    NULL when there is none."""
    lines = F.split(F.coalesce(body, F.lit("")), LINE_SPLIT_RE, -1)
    hits = F.filter(lines, lambda line: F.lower(line).startswith("sitemap:"))
    first = F.element_at(hits, 1)
    return F.when(F.size(hits) > 0, strip_ws(F.regexp_replace(first, "^[^:]*:", "")))


def robots_sitemap(bases: DataFrame, pages: PageStore | DataFrame, base: str = "base_url", mode: str = "a") -> DataFrame:
    """Add ``sitemap_url``: from robots.txt, else the default location.

    mode ``a``: default ``/sitemap.xml`` at the site root; an empty
    ``Sitemap:`` value is returned as ``''`` (no sitemap).
    mode ``b``: default ``sitemap.xml`` relative to the base path; an empty
    value also falls back.
    """
    asked = bases.withColumn("_robots_url", robots_url(F.col(base)))
    rb = store_of(pages).fetch(asked.select(F.col("_robots_url").alias("url")))
    j = asked.join(rb.select(F.col("url").alias("_robots_url"), F.col("body").alias("_robots")), "_robots_url", "left")
    found = sitemap_line(F.col("_robots"))
    if mode == "a":
        default = F.concat(origin(F.col(base)), F.lit("/sitemap.xml"))
        val = F.coalesce(found, default)
    else:
        default = url_join(F.col(base), F.lit("sitemap.xml"))
        val = F.when(found.isNotNull() & (found != ""), found).otherwise(default)
    return j.withColumn("sitemap_url", F.when(F.col(base).isNotNull(), val)).drop("_robots_url", "_robots")


def parse_sitemap_body(body) -> F.Column:
    """``struct(xml, ok, is_index, urls, children)`` of one sitemap document.

    ``xml``: it is well-formed; ``ok``: and it carries the sitemap namespace."""
    def read(b: F.Column) -> F.Column:
        parsed = F.from_xml(F.regexp_replace(b, PREFIX_RE, "<$1"), SITEMAP_SCHEMA, {"mode": "PERMISSIVE"})
        return let(parsed, lambda parsed: _document(b, parsed))
    return let(F.regexp_replace(F.coalesce(body, F.lit("")), PROLOG_RE, ""), read)


def _document(b: F.Column, parsed: F.Column) -> F.Column:
    root = F.regexp_extract(b, ROOT_RE, 1)
    xml = parsed.isNotNull() & parsed["_corrupt_record"].isNull() & (root != "")
    ok = xml & F.contains(b, F.lit(K.SITEMAP_NS))
    locs = lambda arr: F.coalesce(F.transform(arr, lambda x: x["loc"]), F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(xml, F.lit(False)).alias("xml"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        root.endswith("sitemapindex").alias("is_index"),
        F.filter(locs(parsed["url"]), lambda x: x.isNotNull()).alias("urls"),
        F.filter(locs(parsed["sitemap"]), lambda x: x.isNotNull()).alias("children"),
    )


def loose_urls(body, compat: bool = False) -> F.Column:
    """URLs of a body that is not well-formed XML: ``<loc>..</loc>`` matches, else
    bare http(s) URLs (greedy; ``compat`` keeps the lazy pattern that stops one
    character after the scheme)."""
    locs = F.regexp_extract_all(body, F.lit(K.SITEMAP_LOC_LENIENT), 1)
    bare = F.regexp_extract_all(body, F.lit(K.SITEMAP_BARE_URL_COMPAT if compat else BARE_URL_RE), 0)
    return F.when(F.size(locs) > 0, locs).otherwise(bare)


def _placed(doc: DataFrame, items: F.Column, name: str, *under) -> DataFrame:
    """One row per item; ``ord`` gets the branch ``under`` and the position."""
    rows = doc.select("domain", "ord", F.posexplode(items).alias("_i", name))
    place = F.array(*[F.lit(u) for u in under], F.col("_i").cast("int"))
    return rows.select("domain", name, F.concat("ord", place).alias("ord"))


def expand_sitemaps(starts: DataFrame, pages: PageStore | DataFrame, mode: str = "a", compat: bool = False) -> DataFrame:
    """Page URLs listed by the sitemaps of ``starts(domain, sitemap_url)``.

    Returns ``(domain, url, ord)``; ``ord`` is an array of positions that
    sorts in document order (index children expanded in place). In every mode a
    domain reads a sitemap once, at its first place of the earliest level.

    mode ``a``: an index contributes only its children's URLs;
    mode ``b``: child sitemaps first, then the document's own URL locs;
    mode ``lenient``: every loc of the document, child-sitemap locs included,
    followed by the children's URLs; a document that is not well-formed XML,
    start or child, gives its ``loose_urls``.
    """
    store = store_of(pages)
    frontier = starts.filter(F.col("sitemap_url").isNotNull() & (F.col("sitemap_url") != "")).select(
        "domain", F.col("sitemap_url").alias("sm_url"), F.array().cast("array<int>").alias("ord")).distinct()
    frontier = cut_lineage(frontier)
    visited, pieces = frontier.select("domain", "sm_url"), []
    while True:
        body = store.fetch(frontier.select(F.col("sm_url").alias("url"))).select(F.col("url").alias("sm_url"), F.col("body").alias("_body"))
        # parsed once, by all tasks: the files may be few, and a sitemap may be read for many domains
        doc = body.repartition(width(body.sparkSession)).withColumn("p", parse_sitemap_body(F.col("_body")))
        loose = F.when(~F.col("p.xml"), loose_urls(F.col("_body"), compat)) if mode == "lenient" else F.lit(None).cast("array<string>")
        doc = doc.select("sm_url", "p", loose.alias("loose"))
        # a filter would be pushed below the projection, and so parse twice; a generator is not
        doc = doc.select(F.inline(F.filter(F.array(F.struct("sm_url", "p", "loose")), lambda x: x["p"]["ok"] | x["loose"].isNotNull())))
        doc = cut_lineage(frontier.join(doc, "sm_url").select("domain", "ord", "p", "loose"))
        good = doc.filter("p.ok")
        if mode == "a":
            own = _placed(good.filter(~F.col("p.is_index")), F.col("p.urls"), "url")
            kids = _placed(good.filter("p.is_index"), F.col("p.children"), "sm_url")
        elif mode == "b":
            own = _placed(good, F.col("p.urls"), "url", 1).withColumn("url", F.trim("url"))
            kids = _placed(good, F.col("p.children"), "sm_url", 0).withColumn("sm_url", F.trim("sm_url"))
        else:
            own = _placed(good, F.concat("p.urls", "p.children"), "url", 0).withColumn("url", F.trim("url"))
            own = own.unionByName(_placed(doc.filter("NOT p.xml"), F.col("loose"), "url", 0))
            kids = _placed(good, F.col("p.children"), "sm_url", 1).withColumn("sm_url", F.trim("sm_url"))
        pieces.append(own)
        if doc.filter("size(p.children) > 0").isEmpty():
            break
        new = kids.join(visited, ["domain", "sm_url"], "left_anti")
        frontier = cut_lineage(new.groupBy("domain", "sm_url").agg(F.min("ord").alias("ord")))
        visited = visited.unionByName(frontier.select("domain", "sm_url"))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out
