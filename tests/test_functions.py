"""Unit rows for the Column functions (FIXTURES.md section 4)."""

import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from crawlfold.functions import (
    deobfuscate_email, email_plain, email_rfc, extract_context, page_text, score_max, score_rules,
    score_sum, siren_plain, siret_plain, unaccent, url_join,
)


def one(spark, expr, value, schema="text string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,e1,e2", [
    ("123 456 789 00012", ["123456789"], ["12345678900012"]),
    ("12345678900012", [], ["12345678900012"]),
    ("é123456789", [], []),
    ("100 200 300 400", ["100200300"], []),
])
def test_plain_numbers(spark, text, e1, e2):
    assert one(spark, siren_plain("text"), text) == e1
    assert one(spark, siret_plain("text"), text) == e2


def test_plain_nbsp_modes(spark):
    text = "123 456 789"
    assert one(spark, siren_plain("text"), text) == ["123456789"]
    assert one(spark, siren_plain("text", compat=True), text) == ["123 456 789"]


def test_ignore_list(spark):
    text = "123 456 789 00012"
    assert one(spark, siren_plain("text", ["123456789"]), text) == []
    assert one(spark, siret_plain("text", ["123456789"]), text) == ["12345678900012"]


def test_email_pipe(spark):
    assert one(spark, email_plain("text"), "x A.b@C.fr|x y") == ["A.b@C.fr|x"]


@pytest.mark.parametrize("text,siren,siret", [
    ("siret 12345678900012 ok", [], ["12345678900012"]),
    ("SIRET: 12345678900012", [], []),
    ("       \n   siret 12345678900012 ok", [], ["12345678900012"]),
    ("siren 123456789 987654321", ["123456789"], []),
    ("siren 123456789\n987654321", ["123456789", "987654321"], []),
    ("adresse 123.190.179.76", [], []),
    ("siren adresse 123.190.179.76", ["123190179"], []),
    ("siret 123 456 789 00012", [], ["12345678900012"]),
])
def test_context(spark, text, siren, siret):
    df = extract_context(spark.createDataFrame([(text,)], "text string"), "text")
    r = df.first()
    assert r["siren"] == siren and r["siret"] == siret


@pytest.mark.parametrize("text,decoded,emails", [
    ("contact(at)exemple(point)fr", "contact@exemple.fr", ["contact@exemple.fr"]),
    ("Contact [at] Exemple [dot] fr", "contact @ exemple . fr", []),
    ("meet at noon.today", "meet@noon.today", ["meet@noon.today"]),
])
def test_deobfuscate(spark, text, decoded, emails):
    assert one(spark, deobfuscate_email("text"), text) == decoded
    assert one(spark, email_rfc("text"), text) == emails


def test_deobfuscate_strip_spaces(spark):
    assert one(spark, email_rfc("text", strip_spaces=True), "Contact [at] Exemple [dot] fr") == ["contact@exemple.fr"]


@pytest.mark.parametrize("text,emails", [
    ("contact@exemple.fr.", ["contact@exemple.fr"]),
    ("u@[192.168.0.1]", ["u@[192.168.0.1]"]),
    ("n @ no", []),
    ("B@x.fr a@y.fr b@x.fr", ["b@x.fr", "a@y.fr"]),
])
def test_email_rfc(spark, text, emails):
    assert one(spark, email_rfc("text"), text) == emails


def test_page_text(spark):
    assert one(spark, page_text("text"), "<td>123456789</td><td>98</td>") == "12345678998"
    assert one(spark, page_text("text"), '<script>var t="123456789"</script>') == ""
    assert one(spark, page_text("text"), "a&nbsp;b &amp c &copy;") == "a b & c ©"


def test_scores(spark):
    rows = [("https://e.fr/fr/legal", None), ("https://e.fr/blog/p.html", None), ("https://e.fr/x.html", None),
            ("https://e.fr/legal", "Mentions légales"), ("https://e.fr/mentions-legales", None)]
    df = spark.createDataFrame(rows, "url string, t string").select(
        score_rules("url").alias("a"), score_max("url", "t").alias("b"), score_sum("url", "t").alias("c"))
    got = df.collect()
    assert [r["a"] for r in got][:3] == [25, -3, 2]
    assert got[3]["b"] == pytest.approx(1.0 * 1.2 * 1.2)
    assert got[4]["c"] == 4.0


def test_unaccent_matches_python(spark):
    words = ["Éléphant", "ÇA", "Ñu", "straße", "Ångström", "Œuvre", "naïve café", "İstanbul", "ǅemal"]
    df = spark.createDataFrame([(w,) for w in words], "text string").select("text", unaccent("text").alias("u"))
    for r in df.collect():
        want = "".join(c for c in unicodedata.normalize("NFD", r["text"]) if not unicodedata.combining(c)).lower()
        assert r["u"] == want, r["text"]


URL_CASES = [
    ("http://a/b/c/d;p?q", h) for h in
    ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../",
     "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
     "./g/.", "g/./h", "g/../h", "mailto:x@y", "https://other/x", "a//b"]
] + [("http://a", "x/y"), ("http://a/b/", "?"), ("https://h.fr/x?q=1", "#"), ("http://a/b", "?#f")]


def test_url_join_matches_python(spark):
    df = spark.createDataFrame(URL_CASES, "b string, h string").select("b", "h", url_join("b", "h").alias("j"))
    bad = [(r.b, r.h, r.j, urljoin(r.b, r.h)) for r in df.collect() if r.j != urljoin(r.b, r.h)]
    assert not bad
