"""Sitemap edge cases, robots parsing, reports and the flagship pipeline."""

import pytest
from pyspark.sql import functions as F

from crawlfold.functions.keywords import SITEMAP_NS
from crawlfold.operators import site as W
from crawlfold.operators.sitemaps import expand_sitemaps, robots_sitemap

NS = SITEMAP_NS


def snap(spark, rows):
    return spark.createDataFrame(rows, "url string, body string")


def urls_of(df):
    return [r.url for r in df.orderBy("domain", "ord").collect()]


def test_prefixed_and_plain_urlsets(spark):
    s = snap(spark, [
        ("http://a/s1.xml", f'<?xml version="1.0"?><s:urlset xmlns:s="{NS}"><s:url><s:loc>http://a/x</s:loc></s:url></s:urlset>'),
        ("http://a/s2.xml", f'<urlset xmlns="{NS}"><url><loc>http://a/y</loc></url></urlset>'),
        ("http://a/s3.xml", '<urlset><url><loc>http://a/z</loc></url></urlset>'),
        ("http://a/s4.xml", f'<urlset xmlns="{NS}"><url><loc>http://a/trunc'),
    ])
    starts = spark.createDataFrame([("d1", "http://a/s1.xml"), ("d2", "http://a/s2.xml"), ("d3", "http://a/s3.xml"),
                                    ("d4", "http://a/s4.xml")], "domain string, sitemap_url string")
    got = {(r.domain, r.url) for r in expand_sitemaps(starts, s, "a").collect()}
    assert got == {("d1", "http://a/x"), ("d2", "http://a/y")}
    # the fallback is for syntax errors: well-formed XML without the namespace gives nothing
    lenient = {(r.domain, r.url) for r in expand_sitemaps(starts, s, "lenient").collect()}
    assert lenient == {("d1", "http://a/x"), ("d2", "http://a/y"), ("d4", NS), ("d4", "http://a/trunc")}


def test_prologs(spark):
    body = f'<urlset xmlns="{NS}"><url><loc>http://a/{{}}</loc></url></urlset>'
    heads = ['<?xml version="1.0"?>\n<?xml-stylesheet type="text/xsl" href="//a/x.xsl"?>\n', '<!DOCTYPE urlset>', "\ufeff",
             '<?xml version="1.0"?><!-- a > b --><!DOCTYPE urlset [<!ELEMENT url (loc)>]>\n <!--x-->', "\n" * 5000]
    s = snap(spark, [(f"http://a/{i}.xml", h + body.format(i)) for i, h in enumerate(heads)])
    starts = spark.createDataFrame([(f"d{i}", f"http://a/{i}.xml") for i in range(len(heads))], "domain string, sitemap_url string")
    for mode in ("a", "b", "lenient"):
        assert sorted(urls_of(expand_sitemaps(starts, s, mode))) == [f"http://a/{i}" for i in range(len(heads))], mode


def test_deep_cyclic_and_broken_children(spark):
    def index(*urls):
        return f'<sitemapindex xmlns="{NS}">' + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    depth = 20
    rows = [(f"http://a/{i}.xml", index(f"http://a/{i + 1}.xml", f"http://a/{i + 1}.xml", f"http://a/{max(i - 1, 0)}.xml")) for i in range(depth)]
    rows += [(f"http://a/{depth}.xml", f'<urlset xmlns="{NS}"><url><loc>http://a/deep</loc></url></urlset>'),
             ("http://b/i.xml", index("http://b/bad.xml", "http://b/bare.xml")),
             ("http://b/bad.xml", f'<urlset xmlns="{NS}"><url><loc>http://b/x?a=1&b=2</loc></url></urlset>'),
             ("http://b/bare.xml", "see http://b/y, or <b>http://b/z")]
    starts = spark.createDataFrame([("a", "http://a/0.xml"), ("b", "http://b/i.xml")], "domain string, sitemap_url string")
    s = snap(spark, rows)
    assert urls_of(expand_sitemaps(starts, s, "a")) == ["http://a/deep"]
    near = spark.createDataFrame([("a", f"http://a/{depth - 2}.xml"), ("b", "http://b/i.xml")], "domain string, sitemap_url string")
    cut = s.filter(f"url <> 'http://a/{depth - 3}.xml'")
    assert urls_of(expand_sitemaps(near, cut, "b")) == ["http://a/deep"]
    lenient = expand_sitemaps(near, cut, "lenient").cache()
    assert urls_of(lenient.filter("domain = 'a'")).count("http://a/deep") == 1
    assert urls_of(lenient.filter("domain = 'b'")) == [
        "http://b/bad.xml", "http://b/bare.xml", "http://b/x?a=1&b=2", "http://b/y", "http://b/z"]


def test_index_cycle_terminates(spark):
    s = snap(spark, [
        ("http://a/i.xml", f'<sitemapindex xmlns="{NS}"><sitemap><loc>http://a/i.xml</loc></sitemap>'
                           f'<sitemap><loc>http://a/u.xml</loc></sitemap></sitemapindex>'),
        ("http://a/u.xml", f'<urlset xmlns="{NS}"><url><loc>http://a/p1</loc></url><url><loc>http://a/p2</loc></url></urlset>'),
        ("http://a/self.xml", f'<sitemapindex xmlns="{NS}"><sitemap><loc>http://a/self.xml</loc></sitemap></sitemapindex>'),
    ])
    starts = spark.createDataFrame([("d", "http://a/i.xml"), ("e", "http://a/self.xml")], "domain string, sitemap_url string")
    assert urls_of(expand_sitemaps(starts, s, "a")) == ["http://a/p1", "http://a/p2"]
    lenient = urls_of(expand_sitemaps(starts.filter("domain = 'd'"), s, "lenient"))
    assert lenient[:2] == ["http://a/i.xml", "http://a/u.xml"] and "http://a/p1" in lenient


def test_robots_modes(spark):
    s = snap(spark, [("https://a.fr/robots.txt", "User-agent: *\nSITEMAP: https://a.fr/sm.xml\nSitemap: other"),
                     ("https://b.fr/robots.txt", "Sitemap:\n"),
                     ("https://c.fr/robots.txt", "User-agent: *")])
    bases = spark.createDataFrame([("a", "https://a.fr"), ("b", "https://b.fr/fr/"), ("c", "https://c.fr/x/")],
                                  "domain string, base_url string")
    a = {r.domain: r.sitemap_url for r in robots_sitemap(bases, s, mode="a").collect()}
    b = {r.domain: r.sitemap_url for r in robots_sitemap(bases, s, mode="b").collect()}
    assert a == {"a": "https://a.fr/sm.xml", "b": "", "c": "https://c.fr/sitemap.xml"}
    assert b == {"a": "https://a.fr/sm.xml", "b": "https://b.fr/fr/sitemap.xml", "c": "https://c.fr/x/sitemap.xml"}


def test_report_b_partial(spark):
    domains = spark.createDataFrame([("x",), ("y",), ("z",)], "domain string")
    ids = spark.createDataFrame([("x", "siren", "111111111"), ("y", "siren", "1"), ("y", "siret", "2"), ("y", "emails", "m@a.fr"),
                                 ("y", "emails", "n@a.fr")], "domain string, kind string, value string")
    strict = sorted(tuple(r) for r in W.report_b(domains, ids).collect())
    assert strict == [("y", "1", "2", "m@a.fr"), ("y", "1", "2", "n@a.fr"), ("z", "", "", "")]
    partial = sorted(tuple(r) for r in W.report_b(domains, ids, keep_partial=True).collect())
    assert ("x", "111111111", "", "") in partial


def test_error_rate_counts_failed_rows(spark):
    domains = spark.createDataFrame([("a", None), ("b", "boom"), ("c", None)], "domain string, error string")
    bases = spark.createDataFrame([("a", "http://a"), ("b", "http://b"), ("c", None)], "domain string, base_url string")
    sets = spark.createDataFrame([("b", ["1"], [], [])], "domain string, siren array<string>, siret array<string>, emails array<string>")
    report = W.report_a(domains, bases, sets)
    rows = {r.domain: r for r in report.collect()}
    assert (rows["b"].status, rows["b"].error_reason, rows["b"].siren) == ("error", "boom", "")
    legal = report.limit(0)
    log = W.request_log(domains, bases)
    assert sorted(tuple(r) for r in log.collect()) == [
        ("a", "base", "ok"), ("a", "sitemap", "ok"), ("b", "base", "ok"), ("b", "sitemap", "failed"), ("c", "base", "none")]
    stats = W.run_stats(report, legal, log).collect()[0]
    assert (stats.total_requests, stats.error_rate) == (5, "20.00%")
    empty = W.run_stats(report.limit(0), legal, log.limit(0)).collect()[0]
    assert tuple(empty) == (0, 0, 0, 0, 0, "0.00%")


def test_labels_are_glued(spark):
    from crawlfold.operators.links import page_links, scoped_links

    s = snap(spark, [("http://a", '<div class="footer"><a href="/x"> Mentions <b> l&eacute;gales&nbsp;</b></a></div>')])
    assert [r.label for r in page_links(s).collect()] == ["Mentionslégales"]
    assert [r.label for r in scoped_links(s).collect()] == ["Mentionslégales"]


def test_top_urls_duplicates_use_slots(spark):
    rows = [("d", f"u{i % 3}", 1.0, i) for i in range(12)]
    df = spark.createDataFrame(rows, "domain string, url string, score double, ord int")
    got = W.top_urls(df, k=10).orderBy("slot").collect()
    assert [r.url for r in got] == ["u0", "u1", "u2"]


@pytest.fixture(scope="module")
def sf0001(spark):
    import __spark_entry__ as M
    return M


def test_entry_flagship(spark, sf0001):
    df = sf0001.entry(spark)
    rows = df.collect()
    assert df.columns == ["domain", "status", "error_reason", "base_url", "siren", "siret", "emails"]
    by = {r.domain: r for r in rows}
    miss = by["missing.example.net"]
    assert (miss.status, miss.error_reason, miss.base_url, miss.siren) == ("error", "Could not determine base URL", "", "")
    ok = [r for r in rows if r.status == "success"]
    assert len(ok) == len(rows) - 1 and all(r.siret for r in ok)


def test_pipeline_compat_equals_oracle_shape(spark, sf0001):
    a = sf0001.queries()["pipeline_a_compat"](spark, sf0001.SF_SMOKE)
    b = sf0001.queries()["pipeline_a"](spark, sf0001.SF_SMOKE)
    assert a.count() == b.count()
    stats = sf0001.queries()["run_stats"](spark, sf0001.SF_SMOKE).first()
    assert stats.error_rate.endswith("%") and stats.total_requests > 0


def test_results_stable_under_repartition(spark, sf0001):
    from crawlfold.plans.pipeline_a import extract_pages_a
    from crawlfold.sources.derived import site_snapshot
    bodies = site_snapshot(spark, sf0001.SF_SMOKE)["bodies"].select("url", "body")
    one = sorted(map(tuple, extract_pages_a(bodies.coalesce(1)).select("url", F.array_join("siret", ";")).collect()))
    many = sorted(map(tuple, extract_pages_a(bodies.repartition(13)).select("url", F.array_join("siret", ";")).collect()))
    assert one == many


def test_streaming_extraction(spark, tmp_path):
    from crawlfold.streaming import extract_stream, read_snapshot_stream
    src = tmp_path / "in"
    spark.createDataFrame([("http://a/x", "<p>SIRET 123 456 789 00012 c@a.fr</p>")], "url string, body string") \
        .write.parquet(str(src))
    q = (extract_stream(read_snapshot_stream(spark, str(src)))
         .writeStream.format("memory").queryName("cf_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    row = spark.sql("SELECT * FROM cf_stream").first()
    assert row.siret == ["12345678900012"] and row.emails == ["c@a.fr"]


def test_page_lookup_rendered_fallback(spark):
    static = snap(spark, [("http://a/1", "<p>static</p>"), ("http://a/2", ""), ("http://a/dup", "<p>s</p>")])
    rendered = snap(spark, [("http://a/2", "<p>rendered</p>"), ("http://a/3", "<p>only rendered</p>"),
                            ("http://a/dup", "<p>r</p>")])
    urls = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://a/3",), ("http://a/4",), ("http://a/dup",),
                                  ("http://a/dup",)], "url string")
    got = {r.url: r.body for r in W.page_lookup(urls, static, rendered).collect()}
    assert got == {"http://a/1": "<p>static</p>", "http://a/2": "<p>rendered</p>",
                   "http://a/3": "<p>only rendered</p>", "http://a/dup": "<p>s</p>"}
