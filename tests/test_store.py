"""Page store, redirects, scored crawl, ordered CSV and the long report."""

import random

import pytest
from pyspark.sql import functions as F

from crawlfold.operators import site as W
from crawlfold.operators.crawl import crawl_scored
from crawlfold.operators.links import page_links
from crawlfold.plans.pipeline_b import pipeline_b
from crawlfold.sources.store import PageStore, resolve_redirects, store_of, url_index
from crawlfold.sources.tables import read_domain_csv, read_ordered_csv, write_ordered_csv


def snap(spark, rows):
    return spark.createDataFrame(rows, "url string, body string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A store as a crawler writes it: pages by kind, and the index beside them."""
    base = str(tmp_path_factory.mktemp("store"))
    rows = [("https://a.fr", "<p>home</p>", "page"), ("https://a.fr/1", "", "page"), ("https://a.fr/2", None, "page"),
            ("https://a.fr/robots.txt", "Sitemap: https://a.fr/s.xml", "robots")]
    static = spark.createDataFrame(rows, "url string, body string, kind string")
    static.write.partitionBy("kind").parquet(base + "/static")
    snap(spark, [("https://a.fr/1", "<p>one</p>"), ("https://a.fr", "<p>other</p>"), ("https://a.fr/3", "")]).write.parquet(base + "/rendered")
    static, rendered = spark.read.parquet(base + "/static"), spark.read.parquet(base + "/rendered")
    url_index(static, rendered).write.parquet(base + "/index")
    return PageStore(static, rendered, spark.read.parquet(base + "/index"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_static_pages_go_before_rendered_ones(spark, stored):
    urls = spark.createDataFrame([(u,) for u in ("https://a.fr", "https://a.fr/1", "https://a.fr/1", "https://a.fr/2", "https://a.fr/3", "https://b.fr")], "url string")
    both = {"https://a.fr": "<p>home</p>", "https://a.fr/1": "<p>one</p>"}
    for store in (stored, PageStore(stored.static, stored.rendered)):
        assert {r.url: r.body for r in store.fetch(urls, rendered=True).collect()} == both
        assert {r.url: r.body for r in store.fetch(urls).collect()} == {"https://a.fr": "<p>home</p>"}
        assert {(r.url, r.source) for r in store.choose(urls).collect()} == {("https://a.fr", 0), ("https://a.fr/1", 1)}
    assert {r.url: r.body for r in W.page_lookup(urls, stored).collect()} == both
    assert {r.url: r.body for r in store_of(stored.static).fetch(urls).collect()} == {"https://a.fr": "<p>home</p>"}


def test_questions_about_urls_read_no_body(spark, stored):
    domains = spark.createDataFrame([("a.fr",)], "domain string")
    urls = spark.createDataFrame([("https://a.fr",)], "url string")
    for df in (stored.available(), stored.available(rendered=True), stored.choose(urls), W.base_urls(domains, stored)):
        assert "body" not in plan(df) and "index" in plan(df)
    assert "body" in plan(stored.fetch(urls))


def test_redirect_chains(spark):
    hops = [(f"u{i}", f"u{i + 1}") for i in range(30)]  # u0 is 30 hops from its end, one more is too far
    rows = hops + [("far", "u0"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("into", "c1"), ("self", "self"), ("x", "y")]
    got = {r.url: r.final_url for r in resolve_redirects(spark.createDataFrame(rows, "url string, location string")).collect()}
    assert got == {f"u{i}": "u30" for i in range(30)} | {"x": "y"}
    assert resolve_redirects(spark.createDataFrame([], "url string, location string")).count() == 0


def test_base_url_behind_redirects(spark):
    pages = snap(spark, [("http://a.fr", "x"), ("https://b.fr", "x"), ("https://www.b.fr", "moved"), ("http://c.fr", "x"), ("https://d.fr", "")])
    redirects = spark.createDataFrame([("https://www.a.fr", "http://www.a.fr"), ("http://www.a.fr", "http://a.fr"), ("https://www.b.fr", "https://gone.fr"),
                                       ("https://www.c.fr", "http://www.c.fr"), ("http://www.c.fr", "https://www.c.fr"), ("https://www.d.fr", "https://d.fr")],
                                      "url string, location string")
    domains = spark.createDataFrame([("a.fr",), ("b.fr",), ("c.fr",), ("d.fr",)], "domain string")
    got = {r.domain: r.base_url for r in W.base_urls(domains, pages, redirects).collect()}
    assert got == {"a.fr": "http://a.fr", "b.fr": "https://b.fr", "c.fr": "http://c.fr", "d.fr": None}


B = "http://s.fr"


def scored(spark, pages, **bounds):
    s = snap(spark, [(B + u, body) for u, body in pages.items()])
    seeds = spark.createDataFrame([("s", B), ("t", "http://none.fr")], "site string, base string")
    return sorted((r.depth, r.url.removeprefix(B), r.score) for r in crawl_scored(seeds, s, page_links, **bounds).collect())


def test_scored_crawl_by_hand(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = {
        "": "home" + link("/b", "/a", "/c", "http://o.fr/x", "/gone"),  # scores nothing, is read all the same
        "/a": "siret" + link("/deep/legal"),  # text 2.0
        "/b": "capital",  # text 1.0 is not over 1.0
        "/c": "siren capital" + link("/d", "/a"),  # 3.0
        "/d": "rcs" + link("/e"),  # 1.5
        "/deep/legal": "x",  # url 2.0
        "/e": "siret siren",  # 4.0
    }
    assert scored(spark, pages) == [(1, "/a", 2.0), (1, "/c", 3.0), (2, "/d", 1.5), (2, "/deep/legal", 2.0), (3, "/e", 4.0)]
    # cut inside a level: /a is the last page kept, so /c is neither kept nor opened
    assert scored(spark, pages, max_found=1) == [(1, "/a", 2.0)]
    # the second level is read in url order: /d comes before /deep/legal
    assert scored(spark, pages, max_found=3) == [(1, "/a", 2.0), (1, "/c", 3.0), (2, "/d", 1.5)]
    assert scored(spark, pages, min_score=2.5) == [(1, "/c", 3.0), (3, "/e", 4.0)]


def test_scored_crawl_of_a_long_chain_with_cycles(spark):
    pages = {("" if i == 0 else f"/{i}"): f'siret <a href="/{i + 1}">n</a><a href="/{i // 2}">b</a>' for i in range(14)}
    assert [u for _, u, _ in scored(spark, pages, max_found=9)] == [""] + [f"/{i}" for i in range(1, 9)]


def test_csv_files_in_input_order(spark, tmp_path):
    rng = random.Random(7)
    cells, want = [], []
    for f in range(5):
        lines = []
        for i in range(400):
            cell = rng.choice([f"d{f}-{i}.fr", f" d{i % 7}.fr ", "", 'quo"te.fr', "a,b.fr", "dup.fr"])
            cells.append(cell)
            lines.append('"' + cell.replace('"', '""') + f'",{i}')
        (tmp_path / f"part-{f}.csv").write_text("domain,other\n" + "\n".join(lines) + "\n", encoding="utf-8")
    want = [(i, c) for i, c in enumerate(cells) if c]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # several blocks a file, packed anyhow
    try:
        got = sorted(tuple(r) for r in read_domain_csv(spark, str(tmp_path)).select("input_pos", "domain").collect())
        assert got == want
        b = sorted(tuple(r) for r in read_domain_csv(spark, str(tmp_path), "b").select("input_pos", "domain").collect())
        assert b == [(i, c.strip()) for i, c in want if c.strip()]
        report = read_domain_csv(spark, str(tmp_path)).withColumn("status", F.lit("")).repartition(9)
        write_ordered_csv(report, str(tmp_path / "out"), files=3)
        back = read_ordered_csv(spark, str(tmp_path / "out")).orderBy("input_pos").collect()
        assert [r.domain for r in back] == [c for _, c in want] and [r.input_pos for r in back] == list(range(len(want)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_report_of_a_hot_domain_runs_in_many_tasks(spark):
    ids = [("hot", "siren", f"{i:09d}") for i in range(300)] + [("hot", "siret", f"{i:014d}") for i in range(300)] + [("hot", "emails", "a@hot.fr")]
    ids += [("x", "siren", "1"), ("y", "siret", "2"), ("z", "emails", "z@z.fr"), ("w", "siren", "3"), ("w", "siret", "4")]
    ids = spark.createDataFrame(ids, "domain string, kind string, value string")
    domains = spark.createDataFrame([("hot",), ("x",), ("y",), ("z",), ("w",), ("w",), ("none",)], "domain string")
    rows = W.report_b(domains, ids)
    assert sorted(tuple(r) for r in rows.filter("domain <> 'hot'").collect()) == [("none", "", "", ""), ("w", "3", "4", ""), ("w", "3", "4", "")]
    assert rows.filter("domain = 'hot'").distinct().count() == 90_000
    assert "collect" not in plan(rows)  # no cell holds a domain's identifiers
    partial = sorted(tuple(r) for r in W.report_b(domains, ids, keep_partial=True).filter("domain <> 'hot'").collect())
    assert partial == [("none", "", "", ""), ("w", "3", "4", ""), ("w", "3", "4", ""), ("x", "1", "", ""), ("y", "", "2", ""), ("z", "", "", "z@z.fr")]


def test_cascade_reaches_the_rendered_homepage(spark):
    text = "<p>siret 123 456 789 00012</p>"
    static = snap(spark, [("https://a.fr", "<div id=app></div>"), ("https://b.fr", '<div class="bottom"><a href="/js">x</a></div>'), ("https://c.fr", "<p>c</p>")])
    rendered = snap(spark, [("https://a.fr", text), ("https://b.fr/js", text.replace("00012", "00013")), ("https://c.fr", "<p>nothing</p>")])
    domains = spark.createDataFrame([("a.fr",), ("b.fr",), ("c.fr",), ("d.fr",)], "domain string")
    got = sorted(tuple(r) for r in pipeline_b(domains, static, rendered, keep_partial=True).ids.collect())
    assert got == [("a.fr", "siret", "12345678900012"), ("b.fr", "siret", "12345678900013")]
    report = sorted(tuple(r) for r in pipeline_b(domains, static, rendered, keep_partial=True).report.collect())
    assert report == [("a.fr", "", "12345678900012", ""), ("b.fr", "", "12345678900013", ""), ("c.fr", "", "", ""), ("d.fr", "", "", "")]
    assert pipeline_b(domains, static).ids.count() == 0
