"""Pipeline A's report at size: work is done once for a domain, a page or a sitemap,
and wide rows stay where they are made."""

import glob

import crawlfold.operators.sitemaps as SM
import crawlfold.plans.pipeline_a as A
import crawlfold.session as session
import pytest
from crawlfold.functions import keywords as K
from crawlfold.functions.scoring import score_rules
from crawlfold.functions.text import _fold_tables, unaccent
from crawlfold.operators import site as W
from crawlfold.sources.tables import read_ordered_csv, write_ordered_csv
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def watch(monkeypatch, *modules):
    """The plans that ``cut_lineage`` writes from now on."""
    written = []
    cut = session.cut_lineage
    for m in modules:
        monkeypatch.setattr(m, "cut_lineage", lambda df, *a: (written.append(plan(df)), cut(df, *a))[1])
    return written


SETS = "domain string, siren array<string>, siret array<string>, emails array<string>"


def some_report(spark, rows=300):
    names = [f"d{i % 4}.fr" for i in range(rows)]
    domains = spark.createDataFrame([(i, d) for i, d in enumerate(names)], "input_pos long, domain string").repartition(7)
    bases = spark.createDataFrame([("d0.fr", "https://d0.fr"), ("d1.fr", "https://d1.fr"), ("d2.fr", None)], "domain string, base_url string")
    sets = spark.createDataFrame([("d0.fr", ["2", "1", "2"], [], ["b@d.fr", "a@d.fr"]), ("d2.fr", ["9"], None, [])], SETS)
    want = {"d0.fr": ("success", "", "https://d0.fr", "1;2", "", "a@d.fr;b@d.fr"), "d1.fr": ("success", "", "https://d1.fr", "", "", "")}
    bad = ("error", K.ERROR_NO_BASE_URL, "", "", "", "")
    return domains, bases, sets, [(d, *want.get(d, bad)) for d in names]


def test_sets_are_joined_once_a_domain(spark):
    domains, bases, sets, want = some_report(spark)
    report = W.report_a(domains, bases, sets)
    assert [tuple(r)[1:] for r in report.orderBy("input_pos").collect()] == want
    lines = plan(report).splitlines()
    top = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("array_join" in line for line in lines[:top])  # not for each row that names the domain


@pytest.mark.parametrize("cells_chars", [10**6, 3])
def test_report_is_written_in_input_order(spark, tmp_path, monkeypatch, cells_chars):
    """With the cells beside the dealt rows, and with cells too long for that."""
    monkeypatch.setattr(A, "CELLS_CHARS", cells_chars)
    monkeypatch.setattr(A, "FILE_CHARS", 200)
    domains, bases, sets, want = some_report(spark)
    domains = domains.withColumn("domain", F.when(F.col("input_pos") == 0, F.lit('quo"te,.fr')).otherwise(F.col("domain")))
    want[0] = ('quo"te,.fr', "error", K.ERROR_NO_BASE_URL, "", "", "", "")
    cells = session.cut_lineage(W.report_cells(bases, sets))
    dealt = []
    real = A.write_ordered_csv
    monkeypatch.setattr(A, "write_ordered_csv", lambda df, *a, **k: (dealt.append((df.columns, k["files"])), real(df, *a, **k))[1])
    A.write_report_a(domains, cells, str(tmp_path / "out"))
    assert ("emails" in dealt[0][0]) == (cells_chars == 3)
    assert dealt[0][1] > 8  # the files follow the characters, not the session's partitions
    names = sorted(glob.glob(str(tmp_path / "out" / "part-*.csv")))
    lines = [line for n in names for line in open(n, encoding="utf-8").read().splitlines()[1:]]
    assert [line.split(",")[0] for line in lines[1:]] == [w[0] for w in want[1:]]
    back = read_ordered_csv(spark, str(tmp_path / "out")).na.fill("").orderBy("input_pos").collect()
    assert [tuple(r)[:-1] for r in back] == want and [r.input_pos for r in back] == list(range(len(want)))


def test_empty_report_is_written(spark, tmp_path):
    domains, bases, sets, _ = some_report(spark)
    A.write_report_a(domains.limit(0), session.cut_lineage(W.report_cells(bases.limit(0), sets)), str(tmp_path / "out"))
    assert glob.glob(str(tmp_path / "out" / "_SUCCESS"))


def test_csv_rows_are_numbered_where_they_are_read(spark, tmp_path, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("input_pos"), F.concat(F.lit("v"), "id").alias("v"))
    write_ordered_csv(rows, str(tmp_path / "in"), files=3)
    written = watch(monkeypatch, session)
    monkeypatch.setattr("crawlfold.operators.ranking.cut_lineage", session.cut_lineage)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = read_ordered_csv(spark, str(tmp_path / "in"))
        assert "Repartition" not in "".join(written)
        assert sorted(tuple(r) for r in got.collect()) == sorted((f"v{i}", i) for i in range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_are_read_once_for_all_identifiers(spark):
    pages = spark.createDataFrame([("https://a.fr", "<p>siren 123 456 789, x@a.fr</p>")], "url string, body string")
    domains = spark.createDataFrame([("a.fr",), ("a.fr",), ("none.fr",)], "domain string")
    out = A.pipeline_a(domains, pages)
    assert sorted(tuple(r) for r in out.report.collect()) == [
        ("a.fr", "success", "", "https://a.fr", "123456789", "", "x@a.fr")] * 2 + [("none.fr", "error", K.ERROR_NO_BASE_URL, "", "", "", "")]
    assert "regexp" not in plan(out.report) and "regexp" not in plan(W.identifiers(out.candidates.join(out.page_ids, "url")))


def test_urls_of_one_sitemap_are_scored_by_many_tasks(spark, monkeypatch):
    written = watch(monkeypatch, A)
    locs = "".join(f"<url><loc>https://a.fr/{i}.html</loc></url>" for i in range(40))
    pages = spark.createDataFrame([("https://a.fr", "<p>a</p>"), ("https://a.fr/sitemap.xml", f'<urlset xmlns="{K.SITEMAP_NS}">{locs}</urlset>')],
                                  "url string, body string")
    out = A.pipeline_a(spark.createDataFrame([("a.fr",)], "domain string"), pages)
    assert out.candidates.count() == 40
    gated = next(p for p in written if "legal" in p)
    assert "Repartition" in gated


@pytest.mark.parametrize("mode", ["a", "b", "lenient"])
def test_a_sitemap_is_parsed_once(spark, monkeypatch, mode):
    written = watch(monkeypatch, SM)
    files = [("http://a/s.xml", f'<urlset xmlns="{K.SITEMAP_NS}"><url><loc>http://a/1</loc></url><url><loc>http://a/2</loc></url></urlset>'),
             ("http://b/s.xml", "<urlset> <loc>http://b/1</loc>")]
    starts = [("x", "http://a/s.xml"), ("y", "http://a/s.xml"), ("z", "http://b/s.xml")]
    out = SM.expand_sitemaps(spark.createDataFrame(starts, "domain string, sitemap_url string"),
                             spark.createDataFrame(files, "url string, body string"), mode)
    want = [(d, f"http://a/{i}") for d in "xy" for i in (1, 2)] + ([("z", "http://b/1")] if mode == "lenient" else [])
    assert sorted((r.domain, r.url) for r in out.collect()) == want
    parsed = [p for p in written if "from_xml" in p]
    assert [p.count("from_xml") for p in parsed] == [1]
    lines = parsed[0].splitlines()  # and below the join with the domains
    assert any("Join Inner" in line for line in lines[:next(i for i, line in enumerate(lines) if "from_xml" in line)])


def test_folding_of_plain_and_accented_paths(spark):
    words = ["/Mentions-Légales/", "/LEGAL.html", "", None, "/été", "́", "/İstanbul", "/Ǆ", "\x7f\x80"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    src, dst, marks = _fold_tables()
    slow = F.lower(F.regexp_replace(F.translate("w", src, dst), f"[{marks}]+", ""))
    rows = df.select(unaccent("w").alias("a"), slow.alias("b"), score_rules("w").alias("s")).collect()
    assert all(r.a == r.b for r in rows)
    assert [r.s for r in rows[:3]] == [10, 12, 0]
    assert plan(df.select(score_rules("w").alias("s"))).count(marks[:40]) == 1


def test_snapshot_makes_pipeline_b_tables_when_asked(spark, tmp_path, monkeypatch):
    import crawlfold.sources.derived as D

    pages = [(i, f"https://{h}/en/{i}.html", f"<p>page {i}</p>") for i, h in enumerate(["a.fr", "bb.fr", "a.fr", "bb.fr", "ccc.fr", "a.fr"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(0,), (1,), (2,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    written = watch(monkeypatch, D)
    d = D.site_snapshot(spark, str(tmp_path))
    first = len(written)
    assert sum("page" in p and "body" in p for p in written) and first == 7
    b = d["store_b"]
    assert len(written) == first + 3 and d["store_b"] is b and len(written) == first + 3
    assert {r.url for r in b.static.collect()} == {r.url for r in d["snapshot"].collect()}
    assert d["redirects"].columns == ["url", "location"] and len(written) == first + 4
