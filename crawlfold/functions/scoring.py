"""Page-relevance scores as Column expressions (no joins, no UDFs).

* ``score_rules``  - additive integer rules on the URL path (pipeline A gate);
* ``score_max``    - max keyword weight in URL / link text (pipeline A crawl);
* ``score_sum``    - sum of keyword weights in URL and page text (pipeline B).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.text import let
from crawlfold.functions.urls import contains_any, normalize_url, url_path


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_rules(url) -> Column:
    """Integer score of a URL from its path (see module doc)."""
    return let(normalize_url(url), lambda npath: _rules(_col(url), npath))


def _rules(u: Column, npath: Column) -> Column:
    parts = F.split(F.lower(url_path(u)), "/", -1)
    legal_arr = F.array(*[F.lit(w) for w in K.LEGAL_PATH_WORDS])
    localized = (
        (F.size(parts) >= 2)
        & F.element_at(parts, 2).isin(*K.LOCALE_SEGMENTS)
        & F.arrays_overlap(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), legal_arr)
    )
    legal = contains_any(npath, K.LEGAL_PATH_WORDS)
    suffix = F.lower(u).rlike("(?:" + "|".join("\\Q" + s + "\\E" for s in K.PAGE_SUFFIXES) + ")$")
    terms = [
        F.when(localized, K.SCORE_LOCALIZED).otherwise(0),
        F.when(contains_any(npath, ["footer"]) & legal, K.SCORE_FOOTER_LEGAL).otherwise(0),
        F.when(legal, K.SCORE_LEGAL).otherwise(0),
        F.when(contains_any(npath, K.SECONDARY_PATH_WORDS), K.SCORE_SECONDARY).otherwise(0),
        F.when(suffix, K.SCORE_SUFFIX).otherwise(0),
        F.when(contains_any(npath, K.IRRELEVANT_PATH_WORDS), K.SCORE_IRRELEVANT).otherwise(0),
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("int")


def score_max(url, text=None) -> Column:
    """Max keyword weight in the lower-cased URL; link-text hits weigh 1.2x;
    the result is multiplied by 1.2 when the path has at most two parts."""
    u = F.lower(_col(url))
    score = F.lit(0.0)
    for kw, w in K.CRAWL_WEIGHTS:
        score = F.greatest(score, F.when(F.contains(u, F.lit(kw)), F.lit(float(w))))
    if text is not None:
        t = _col(text)
        tl = F.lower(t)
        with_text = score
        for kw, w in K.CRAWL_WEIGHTS:
            with_text = F.greatest(with_text, F.when(F.contains(tl, F.lit(kw)), F.lit(w * K.CRAWL_TEXT_BONUS)))
        score = F.when(t.isNotNull() & (t != ""), with_text).otherwise(score)
    n_parts = F.size(F.split(url_path(_col(url)), "/", -1))
    return F.when(n_parts <= K.CRAWL_SHORT_PATH_PARTS, score * K.CRAWL_SHORT_PATH_BONUS).otherwise(score)


def score_sum(url, text=None) -> Column:
    """Sum of URL keyword weights plus page-text keyword weights (each once)."""
    u = F.lower(_col(url))
    total = F.lit(0.0)
    for kw, w in K.URL_SUM_WEIGHTS:
        total = total + F.when(F.contains(u, F.lit(kw)), F.lit(float(w))).otherwise(F.lit(0.0))
    if text is not None:
        tl = F.coalesce(F.lower(_col(text)), F.lit(""))
        for kw, w in K.TEXT_SUM_WEIGHTS:
            total = total + F.when(F.contains(tl, F.lit(kw)), F.lit(float(w))).otherwise(F.lit(0.0))
    return total
