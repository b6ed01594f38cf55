"""URL Column functions: parts, variants, joins, predicates.

RFC 3986 reference resolution is written with string and array built-ins;
the common shapes (absolute, ``//host``, ``/path`` with no dot segment) take a
cheap branch, dot segments go through one array fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.text import let, unaccent

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY_RE = r"^[^?#]*\?([^#]*)"
FRAGMENT_RE = r"#(.*)$"
DOT_SEGMENT_RE = r"(^|/)\.\.?(/|$)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME_RE, 1))


def netloc(url) -> Column:
    """Authority part, port and user info kept, case kept ('' when absent)."""
    return F.regexp_extract(_col(url), NETLOC_RE, 1)


def url_path(url) -> Column:
    return F.regexp_extract(_col(url), PATH_RE, 1)


def url_query(url) -> Column:
    return F.regexp_extract(_col(url), QUERY_RE, 1)


def origin(url) -> Column:
    """``scheme://netloc`` of an absolute URL."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def domain_key(domain) -> Column:
    """Lower-cased, stripped domain; a URL given as domain keeps its netloc."""
    d = F.lower(strip_ws(domain))
    return F.when(d.rlike("^https?://"), netloc(d)).otherwise(d)


def url_variants(domain) -> Column:
    """The four base-URL candidates, in trial order."""
    d = domain_key(domain)
    return F.array(*[F.concat(F.lit(t.split("{}")[0]), d) for t in K.URL_VARIANT_TEMPLATES])


def _remove_dot_segments(segs: Column) -> Column:
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    return F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def url_join(base, href) -> Column:
    """Resolve ``href`` against ``base`` (Python ``urljoin`` semantics for
    http(s) bases): a scheme keeps ``href`` as is, ``//`` takes the base
    scheme, ``/`` the base origin, ``?``/``#``/empty the base path, anything
    else the base directory; dot segments are then removed."""
    return let(_col(href), lambda h: _joined(_col(base), h))


def _joined(b: Column, h: Column) -> Column:
    b_origin = F.concat(scheme(b), F.lit("://"), netloc(b))
    b_path = url_path(b)
    b_query = url_query(b)
    return let(F.struct(url_path(h).alias("path"), F.regexp_extract(h, r"^[^?#]*(.*)$", 1).alias("tail")),
               lambda x: _resolved(b, h, b_origin, b_path, b_query, x["path"], x["tail"]))


def _resolved(b, h, b_origin, b_path, b_query, h_path, h_tail) -> Column:
    """``h_tail``: query and fragment of the reference."""
    h_has_query = h_tail.rlike(r"^\?[^#]")
    # directory of the base path (up to the last '/'); '' base path acts as '/'
    b_dir = F.regexp_extract(b_path, r"^(.*/)", 1)
    rel = F.regexp_replace(F.concat(F.when(b_dir == "", F.lit("/")).otherwise(b_dir), h_path), "//+", "/")
    merged = F.when(h_path.startswith("/"), h_path).otherwise(rel)
    segs = F.split(merged, "/", -1)
    dotted = F.array_join(_remove_dot_segments(segs), "/")
    dotted = F.when(dotted == "", F.lit("/")).otherwise(dotted)
    dotted = F.when(dotted.startswith("/"), dotted).otherwise(F.concat(F.lit("/"), dotted))
    path = F.when(merged.rlike(DOT_SEGMENT_RE), dotted).otherwise(merged)
    # trailing '?'/'#' with nothing after them are dropped, as urlunsplit does
    tail = F.regexp_replace(F.regexp_replace(h_tail, r"#$", ""), r"^\?(#|$)", "$1")
    base_noq = F.concat(b_origin, b_path)
    no_path = F.when(
        h_has_query, F.concat(base_noq, tail)
    ).otherwise(
        F.concat(base_noq, F.when(b_query != "", F.concat(F.lit("?"), b_query)).otherwise(F.lit("")), tail)
    )
    return (
        F.when(b.isNull() | (b == ""), h)
        .when(h.isNull(), F.lit(None))
        .when(h == "", b)
        .when(h.rlike(SCHEME_RE), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h_path == "", no_path)
        .otherwise(F.concat(b_origin, path, tail))
    )


def same_host(url, base) -> Column:
    return netloc(url) == netloc(base)


def internal_link(url, base) -> Column:
    n = netloc(url)
    return (n == "") | (n == netloc(base))


def skip_scheme(href, prefixes=K.SKIP_HREF_PREFIXES_L2) -> Column:
    """True for hrefs to drop (fragment-only, javascript:, tel:, mailto:)."""
    h = _col(href)
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | h.startswith(p)
    return cond


def http_only(url) -> Column:
    u = _col(url)
    return u.startswith("http://") | u.startswith("https://")


def normalize_url(url) -> Column:
    """Path only, '/' trimmed at both ends, accents folded, lower-cased."""
    return unaccent(F.regexp_replace(url_path(url), "^/+|/+$", ""))


def any_word_pattern(words) -> str:
    """One Java regex matching any of ``words`` literally (each \\Q-quoted)."""
    return "(?:" + "|".join("\\Q" + w + "\\E" for w in sorted(set(words), key=lambda x: (-len(x), x))) + ")"


def contains_any(c: Column, words) -> Column:
    """``c`` contains one of ``words`` (substring test).

    A single regex keeps ``c`` in the plan once: with one ``contains`` per
    word, a pushed-down filter would copy an expensive ``c`` into every
    term."""
    return F.coalesce(c.rlike(any_word_pattern(words)), F.lit(False))


def candidate_keyword(url) -> Column:
    """Accent-folded URL contains an accent-folded candidate keyword."""
    import unicodedata

    def fold(s: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.combining(ch)).lower()

    words = sorted({fold(k) for k in K.CANDIDATE_KEYWORDS})
    return contains_any(unaccent(url), words)
