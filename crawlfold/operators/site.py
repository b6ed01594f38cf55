"""Per-domain steps: base URL choice, page lookup, candidate URLs, top-k,
set union, counters and the two report shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.extract import joined, sorted_set
from crawlfold.functions.scoring import score_rules
from crawlfold.functions.urls import url_variants
from crawlfold.operators.ranking import rank_within
from crawlfold.sources.store import PageStore, resolve_redirects, store_of

Pages = PageStore | DataFrame


def _empty():
    return F.array().cast("array<string>")


def variants(domains: DataFrame) -> DataFrame:
    """``(domain, variant_rank, url)``: the four base-URL candidates."""
    return domains.select("domain", F.posexplode(url_variants(F.col("domain"))).alias("variant_rank", "url"))


def base_urls(domains: DataFrame, pages: Pages, redirects: DataFrame | None = None) -> DataFrame:
    """``(domain, base_url)`` per distinct domain; ``base_url`` is the first
    variant that was fetched, NULL when none was. With ``redirects(url,
    location)`` a variant that redirects counts where its chain ends at a fetched
    page, and that end is the base URL. Reads the store's index, no body."""
    keys = domains.select("domain").distinct()
    ok = store_of(pages).available()
    ends = ok.select("url", F.col("url").alias("final_url"))
    if redirects is not None:
        moved = resolve_redirects(redirects).join(ok.select(F.col("url").alias("final_url")), "final_url", "left_semi")
        ends = ends.join(redirects.select("url"), "url", "left_anti").unionByName(moved.select("url", "final_url"))
    hits = variants(keys).join(ends, "url")
    chosen = hits.groupBy("domain").agg(F.min_by("final_url", "variant_rank").alias("base_url"))
    return keys.join(chosen, "domain", "left")


def page_lookup(urls: DataFrame, pages: Pages, rendered: DataFrame | None = None) -> DataFrame:
    """``(url, body)`` for the distinct ``urls`` that were fetched; a URL missing
    from (or empty in) the static snapshot takes the rendered body, if the store
    has one (or ``rendered`` is given beside a plain snapshot)."""
    return store_of(pages, rendered).fetch(urls, rendered=True)


def candidates_scored(urls: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep URLs with a positive rule score, best first, ties in input order."""
    s = urls.withColumn("score", score_rules(F.col("url"))).filter(F.col("score") > 0)
    placed = s.withColumn("_place", F.struct((-F.col("score")).alias("s"), F.col(pos).alias("p"), F.col("url").alias("u")))
    return rank_within(placed, "domain", "_place", "rank", None).drop("_place")


def candidates_gate(urls: DataFrame) -> DataFrame:
    """URLs whose rule score exceeds 1 (``legal`` flags mentions/legal URLs)."""
    s = urls.withColumn("score", score_rules(F.col("url"))).filter(F.col("score") > K.GATE_MIN_SCORE)
    lower = F.lower(F.col("url"))
    legal = F.lit(False)
    for w in K.LEGAL_COUNT_WORDS:
        legal = legal | F.contains(lower, F.lit(w))
    return s.withColumn("legal", legal)


def homepage_fallback(bases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, plus the base URL for domains that have none."""
    missing = bases.filter(F.col("base_url").isNotNull()).join(
        candidates.select("domain").distinct(), "domain", "left_anti")
    return candidates.select("domain", "url").unionByName(missing.select("domain", F.col("base_url").alias("url")))


def top_urls(scored: DataFrame, k: int = K.TOP_URLS_PER_STAGE, order: str = "ord") -> DataFrame:
    """First ``k`` URLs per domain by score (ties in input order); duplicates
    use up slots and are then dropped. ``row_number <= k`` is planned as a
    partial top-k before the shuffle."""
    w = Window.partitionBy("domain").orderBy(F.col("score").desc(), order)
    top = scored.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= k)
    w2 = Window.partitionBy("domain", "url").orderBy("slot")
    return top.withColumn("_k", F.row_number().over(w2)).filter("_k = 1").drop("_k")


def identifiers(found: DataFrame, key: str = "domain") -> DataFrame:
    """``(key, kind, value)``: the distinct identifiers of per-page arrays ``siren``,
    ``siret`` and ``emails``, a row each, however many a domain has."""
    kinds = [found.select(key, F.lit(kind).alias("kind"), F.explode(kind).alias("value")) for kind in ("siren", "siret", "emails")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct()


def union_per_domain(found: DataFrame, key: str = "domain") -> DataFrame:
    """``(key, siren, siret, emails)`` sorted sets from per-page arrays.

    Values are exploded and de-duplicated on (key, kind, value) first - a
    partial aggregation spread over the values - so a domain with many pages
    never gathers its raw page arrays in one task; only its distinct values
    are collected, and that set is the output row itself.
    """
    return sets_of(identifiers(found, key), key)


def sets_of(ids: DataFrame, key: str = "domain") -> DataFrame:
    """``(key, siren, siret, emails)`` sorted sets of an identifier table."""
    agg = ids.groupBy(key).agg(
        *[sorted_set(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k)
          for k in ("siren", "siret", "emails")])
    return agg


def report_a(domains: DataFrame, bases: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per input domain row: status, reason, base URL and the three
    sets as sorted ``;``-joined strings (``''`` when empty). An ``error`` column
    of ``domains`` (what went wrong while its pages were fetched) is the row's
    reason and leaves the rest empty."""
    return report_rows(domains, report_cells(bases, sets))


def report_cells(bases: DataFrame, sets: DataFrame) -> DataFrame:
    """``(domain, base_url, siren, siret, emails)`` per distinct domain, the sets as
    strings: joined once, however many input rows name the domain."""
    text = sets.select("domain", *[joined(F.coalesce(c, _empty())).alias(c) for c in ("siren", "siret", "emails")])
    return bases.join(text, "domain", "left")


def report_rows(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """The report (``report_a``) of the input rows from ``report_cells``."""
    failed = F.col("error") if "error" in domains.columns else F.lit(None).cast("string")
    j = domains.join(cells, "domain", "left").withColumn("_failed", failed)
    j = j.withColumn("base_url", F.when(F.col("_failed").isNull(), F.col("base_url")))
    ok = F.col("base_url").isNotNull()
    return j.select(
        *([c for c in ["input_pos"] if c in domains.columns]),
        "domain",
        F.when(ok, F.lit(K.STATUS_OK)).otherwise(F.lit(K.STATUS_ERROR)).alias("status"),
        F.when(ok, F.lit("")).otherwise(F.coalesce("_failed", F.lit(K.ERROR_NO_BASE_URL))).alias("error_reason"),
        F.coalesce("base_url", F.lit("")).alias("base_url"),
        *[F.when(ok, F.coalesce(c, F.lit(""))).otherwise(F.lit("")).alias(c) for c in ("siren", "siret", "emails")],
    )


def report_b(domains: DataFrame, ids: DataFrame, keep_partial: bool = False) -> DataFrame:
    """Long report of an identifier table ``(domain, kind, value)``: siren x siret x
    (email or ''), one blank row for a domain with nothing. Without
    ``keep_partial`` a domain with SIRENs but no SIRET (or the reverse) yields no
    row, as nested loops over an empty list do.

    The product is two joins on the domain over the long table: no cell holds a
    domain's identifiers, and a domain with very many is split over tasks."""
    has = ids.groupBy("domain").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("siren", "siret", "emails")])

    def values(kind: str, name: str, or_blank: bool) -> DataFrame:
        own = ids.filter(F.col("kind") == kind).select("domain", F.col("value").alias(name))
        blank = has.filter(~F.col(kind)).select("domain", F.lit("").alias(name))
        return own.unionByName(blank) if or_blank else own

    rows = values("siren", "siren", keep_partial).join(values("siret", "siret", keep_partial), "domain")
    rows = rows.join(values("emails", "email", True), "domain")
    pos = [c for c in ["input_pos"] if c in domains.columns]
    listed = domains.select(*pos, "domain").join(rows, "domain").select(*pos, "domain", "siren", "siret", "email")
    blank = domains.select(*pos, "domain").join(has, "domain", "left_anti")
    return listed.unionByName(blank.select(*pos, "domain", *[F.lit("").alias(c) for c in ("siren", "siret", "email")]))


def request_log(domains: DataFrame, bases: DataFrame) -> DataFrame:
    """``(domain, request, outcome)``, a row per request of the domain rows: one for
    the base URL (``ok``, or ``none`` when no variant answered), one for the
    sitemap of a found base (``failed`` when the domain's ``error`` column says
    what went wrong while it was read, else ``ok``)."""
    failed = F.col("error").isNotNull() if "error" in domains.columns else F.lit(False)
    rows = domains.join(bases, "domain", "left").select(
        "domain", F.col("base_url").isNotNull().alias("found"), failed.alias("failed"))
    base = F.struct(F.lit("base").alias("request"), F.when(F.col("found"), F.lit("ok")).otherwise(F.lit("none")).alias("outcome"))
    sitemap = F.struct(F.lit("sitemap").alias("request"), F.when(F.col("failed"), F.lit("failed")).otherwise(F.lit("ok")).alias("outcome"))
    sent = F.when(F.col("found"), F.array(base, sitemap)).otherwise(F.array(base))
    return rows.select("domain", F.explode(sent).alias("r")).select("domain", "r.request", "r.outcome")


def run_stats(report: DataFrame, legal_pages: DataFrame, log: DataFrame) -> DataFrame:
    """One-row counters: id counts summed per report row, legal page count, and
    from the request log the number of requests and the share that failed."""
    def n(c):
        return F.when(F.col(c) == "", 0).otherwise(F.size(F.split(F.col(c), ";")))
    ids = report.agg(*[F.coalesce(F.sum(n(c)), F.lit(0)).cast("bigint").alias(name) for c, name in
                       (("siren", "siren_count"), ("siret", "siret_count"), ("emails", "email_count"))])
    requests = log.agg(F.count(F.lit(1)).cast("bigint").alias("total_requests"),
                       F.count(F.when(F.col("outcome") == "failed", 1)).alias("errors"))
    legal = legal_pages.agg(F.count(F.lit(1)).cast("bigint").alias("legal_pages_count"))
    rate = F.when(F.col("total_requests") > 0, F.col("errors") / F.col("total_requests") * 100).otherwise(F.lit(0.0))
    return ids.crossJoin(legal).crossJoin(requests).select(  # one row each
        "siren_count", "siret_count", "email_count", "legal_pages_count", "total_requests",
        F.format_string("%.2f%%", rate.cast("double")).alias("error_rate"))
