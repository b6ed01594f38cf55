"""The queries named after the fallback include the crawl of domains without a sitemap."""

import duckdb
import pytest

from __spark_entry__ import queries
from crawlfold.sources.tables import DRIVER_TABLES
from oracle_sql import build_oracle_sql

SF = "/root/testdata/sf0.001"
# over the tables that the SQL of pipeline_a derives, crawl levels included
WANT = {
    "source_fallback": "SELECT DISTINCT domain, url FROM src_all",
    "homepage_fallback": "SELECT DISTINCT domain, url FROM targets",
    "legal_pages": "SELECT domain, count(*) AS legal_pages FROM gated WHERE legal GROUP BY domain",
}


@pytest.mark.parametrize("key", WANT)
def test_domains_without_a_sitemap_are_crawled(spark, key):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = build_oracle_sql()["pipeline_a"]
    assert sql.endswith("\nSELECT * FROM report")
    head = sql.removesuffix("SELECT * FROM report")
    want = sorted(con.execute(head + WANT[key]).fetchall())
    crawled = {r[0] for r in con.execute(head + "SELECT DISTINCT site FROM u").fetchall()}
    got = sorted(tuple(r) for r in queries()[key](spark, SF).select("domain", "legal_pages" if key == "legal_pages" else "url").collect())
    assert got == want
    assert crawled and (key == "legal_pages" or crawled <= {r[0] for r in got})
