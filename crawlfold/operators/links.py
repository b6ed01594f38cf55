"""Link extraction jobs over a snapshot: ``(url, body)`` -> one row per link.

* ``page_links``    every ``<a href>`` with its position, href and anchor
  text (Catalyst regexes; narrow, no shuffle);
* ``scoped_links``  anchors and frames in one link table, tagged with footer
  scope (an open ``footer``/``div`` whose class contains a word), by the element
  scopes of ``functions.elements``;
* ``frame_links``   its frames, resolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.elements import attr_source, elements
from crawlfold.functions.text import decode_entities, glued_text, let, page_text
from crawlfold.functions.urls import (
    candidate_keyword, contains_any, http_only, internal_link, netloc, skip_scheme, strip_ws, url_join,
)

ANCHOR_RE = r"(?is)<a(\s[^>]*)?>(.*?)</a\s*>"


def _attr(attrs: F.Column, name: str) -> F.Column:
    """Value of attribute ``name`` in a start-tag attribute string (NULL when
    absent); double-quoted, single-quoted or bare; entities decoded."""
    pat = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    bare = F.regexp_replace(F.regexp_extract(attrs, pat, 1), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.when(attrs.rlike(pat), decode_entities(bare))


def page_links(snapshot: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``(url, pos, href, text, title, label)`` for every ``<a ... href=...>``;
    ``pos`` is the 0-based document position among the page's anchors with an
    href, ``label`` the text with its nodes stripped and glued.
    One narrow projection + explode: no shuffle."""
    attrs = F.regexp_extract_all(F.col(body), F.lit(ANCHOR_RE), 1)
    inner = F.regexp_extract_all(F.col(body), F.lit(ANCHOR_RE), 2)
    zipped = F.arrays_zip(attrs.alias("attrs"), inner.alias("inner"))
    with_href = F.filter(zipped, lambda a: F.coalesce(a["attrs"], F.lit("")).rlike(r"(?is)(?:^|\s)href\s*="))
    ex = snapshot.select(F.col(url).alias("url"), F.posexplode(with_href).alias("pos", "a"))
    a = F.coalesce(F.col("a.attrs"), F.lit(""))
    return ex.select(
        "url", F.col("pos").cast("int").alias("pos"),
        _attr(a, "href").alias("href"),
        page_text(F.col("a.inner")).alias("text"),
        _attr(a, "title").alias("title"),
        glued_text(F.col("a.inner")).alias("label"),
    )


def keyword_links(links: DataFrame, base: str = "base") -> DataFrame:
    """Links whose lower-cased text contains a candidate keyword; joined to
    ``base``, http(s) only."""
    joined_url = url_join(F.col(base), F.col("href"))
    out = links.filter(contains_any(F.lower(F.col("text")), K.CANDIDATE_KEYWORDS)).withColumn("link", joined_url)
    return out.filter(http_only(F.col("link")))


def internal_keyword_links(links: DataFrame, base: str = "base") -> DataFrame:
    """Homepage links: joined, internal (no or same netloc), unique in
    document order, accent-folded URL containing a candidate keyword."""
    j = links.filter(F.col("href") != "").withColumn("link", url_join(F.col(base), F.col("href")))
    j = j.filter(internal_link(F.col("link"), F.col(base)))
    from pyspark.sql import Window
    w = Window.partitionBy("url", "link").orderBy("pos")
    j = j.withColumn("_first", F.row_number().over(w)).filter(F.col("_first") == 1).drop("_first")
    return j.filter(candidate_keyword(F.col("link")))


# ---------------------------------------------------------------------------
# links with the element scope they stand in
# ---------------------------------------------------------------------------

FOOTER_A, FOOTER_B = 1, 2  # marks of elements


def _footer_marks(tag: F.Column, name: F.Column) -> F.Column:
    """Marks of a start tag: a footer or div whose class holds a footer word."""
    cls = F.lower(attr_source(tag, "class"))
    a, b = (F.when(contains_any(cls, words), F.lit(bit)).otherwise(F.lit(0))
            for words, bit in ((K.FOOTER_CLASS_WORDS_A, FOOTER_A), (K.FOOTER_CLASS_WORDS_B, FOOTER_B)))
    return F.when(name.isin("footer", "div"), a + b).otherwise(F.lit(0)).cast("bigint")


_OPEN, _CLOSE = "\x01", "\x02"  # taken out of the page before they mark its anchors


def _edges(e: F.Column) -> F.Column:
    """Anchors (with what stands up to their end or the next anchor), then frames."""
    anchor = lambda t: (t["name"] == "a") & (t["kind"] == 1) & t["tok"].rlike(r"(?is)\shref\s*=")
    marked = F.array_join(F.transform(e, lambda t: F.when(anchor(t), F.lit(_OPEN)).when((t["name"] == "a") & (t["kind"] == -1), F.lit(_CLOSE))
                                      .when(t["inert"], F.lit("")).otherwise(t["tok"])), "")
    inner = F.transform(F.slice(F.split(marked, _OPEN, -1), 2, F.size(e) + 1), lambda x: F.substring_index(x, _CLOSE, 1))
    one = lambda kind, tok, text, above: F.struct(F.lit(kind).alias("kind"), tok.alias("tok"), text.alias("inner"), above.alias("above"))
    anchors = F.zip_with(F.filter(e, anchor), inner, lambda t, x: one("a", t["tok"], x, t["above"]))
    frames = F.filter(e, lambda t: t["name"].isin("frame", "iframe") & (t["kind"] >= 0))
    frames = F.transform(frames, lambda t: one("frame", t["tok"], F.lit(""), t["above"]))
    number = lambda arr: F.transform(arr, lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    return F.concat(number(anchors), number(frames))


def scoped_links(snapshot: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``(url, pos, href, text, title, label, in_footer_a, in_footer_b, is_frame)``:
    one link table of anchors with an href and of frames (``href`` their
    source, ``''`` if none), each kind numbered in document order, with whether
    a footer element is open around it. A narrow projection and one explode."""
    clean = F.translate(F.coalesce(F.col(body), F.lit("")), _OPEN + _CLOSE, "")
    ex = snapshot.select(F.col(url).alias("url"), F.explode(let(elements(clean, _footer_marks), _edges)).alias("e"))
    ex = ex.select("url", "e.pos", "e.x.*")
    frame = F.col("kind") == "frame"
    return ex.select(
        "url", F.col("pos").cast("int").alias("pos"),
        F.when(frame, F.coalesce(_attr(F.col("tok"), "src"), F.lit(""))).otherwise(_attr(F.col("tok"), "href")).alias("href"),
        page_text(F.col("inner")).alias("text"), F.when(~frame, _attr(F.col("tok"), "title")).alias("title"),
        glued_text(F.col("inner")).alias("label"),
        (F.col("above").bitwiseAND(FOOTER_A) > 0).alias("in_footer_a"), (F.col("above").bitwiseAND(FOOTER_B) > 0).alias("in_footer_b"),
        frame.alias("is_frame"))


def frame_links(scoped: DataFrame, base: str = "base") -> DataFrame:
    """Frames with a source, joined to ``base``, http(s) only."""
    s = scoped.filter(F.col("is_frame") & (F.col("href") != "")).withColumn("link", url_join(F.col(base), F.col("href")))
    return s.filter(http_only(F.col("link")))


def footer_links_a(scoped: DataFrame, base: str = "base") -> DataFrame:
    """Footer links, pipeline A: class contains 'footer'; hrefs not starting
    with http/https/mailto/tel/# are joined to the base; same host only."""
    s = scoped.filter(F.col("in_footer_a") & ~F.col("is_frame"))

    def link(href):
        keep_as_is = F.lit(False)
        for p in K.KEEP_AS_IS_PREFIXES_L1:
            keep_as_is = keep_as_is | href.startswith(p)
        return F.when(keep_as_is, href).otherwise(url_join(F.col(base), href))

    s = s.withColumn("link", let(F.col("href"), link))
    return s.filter(netloc(F.col("link")) == netloc(F.col(base)))


def legal_links(scoped: DataFrame, base: str = "base") -> DataFrame:
    """Pipeline A link set: every link inside footer/bottom/bas-page zones plus
    links whose text or title mentions a legal/secondary word; javascript:,
    tel:, mailto:, # dropped; distinct per page."""
    s = scoped.filter(~F.col("is_frame")).withColumn("h", strip_ws(F.col("href")))
    s = s.filter((F.col("h") != "") & ~skip_scheme(F.col("h")))
    words = K.LEGAL_PATH_WORDS + K.SECONDARY_PATH_WORDS
    label = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    s = s.filter(F.col("in_footer_b") | contains_any(label, words))
    return s.select("url", url_join(F.col(base), F.col("h")).alias("link")).distinct()


def footer_links_b(scoped: DataFrame, base: str = "base") -> DataFrame:
    """Pipeline B footer links (footer/bottom/bas-page), joined, http(s)."""
    s = scoped.filter(F.col("in_footer_b") & ~F.col("is_frame"))
    s = s.withColumn("link", url_join(F.col(base), F.col("href")))
    return s.filter(http_only(F.col("link")))
