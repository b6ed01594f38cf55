"""Identifier and e-mail extraction as Column functions.

Two families:

* plain extraction (pipeline A): SIREN / SIRET / e-mail regexes over the
  page text, sets sorted, optional ignore list;
* context extraction (pipeline B): looser number patterns kept only when one
  of the context keywords is a whole word within ten words of the number,
  a SIREN dropped when it starts an accepted SIRET, de-obfuscated RFC e-mails.

All of it is Catalyst expressions (regex, higher-order array functions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.text import clean_ws, collapse_ws, deobfuscate_email, let

MARK = "\u0001"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def sorted_set(arr: Column) -> Column:
    """Distinct, ascending, never NULL (a missing input becomes ``[]``)."""
    return F.coalesce(F.array_sort(F.array_distinct(arr)), F.array().cast("array<string>"))


def joined(arr: Column, sep: str = ";") -> Column:
    """Sorted set rendered as one string, ``''`` when empty."""
    return F.array_join(sorted_set(arr), sep)


# ---------------------------------------------------------------------------
# plain extraction (A)
# ---------------------------------------------------------------------------

def _strip_number(x: Column, compat: bool) -> Column:
    # compat: only ASCII blanks are removed (a no-break space stays inside)
    if compat:
        return F.replace(x, F.lit(" "), F.lit(""))
    return F.regexp_replace(x, r"(?U)\s", "")


def _plain_numbers(text, pattern: str, ignored, compat: bool) -> Column:
    found = F.regexp_extract_all(clean_ws(_col(text)), F.lit("(?U)" + pattern), 1)
    nums = F.transform(found, lambda x: _strip_number(x, compat))
    if ignored:
        nums = F.array_except(nums, _lit_array(sorted(set(ignored))))
    return sorted_set(nums)


def siren_plain(text, ignored=(), compat: bool = False) -> Column:
    """9-digit numbers (optionally blank-separated in 3s), sorted set."""
    return _plain_numbers(text, K.SIREN_PLAIN, ignored, compat)


def siret_plain(text, ignored=(), compat: bool = False) -> Column:
    """14-digit numbers (3-3-3-5, optional blanks), sorted set."""
    return _plain_numbers(text, K.SIRET_PLAIN, ignored, compat)


def email_plain(text) -> Column:
    """Simple e-mail pattern, case kept, sorted set."""
    return sorted_set(F.regexp_extract_all(clean_ws(_col(text)), F.lit(K.EMAIL_PLAIN), 0))


def email_simple(text) -> Column:
    """The short ``word@word.word`` pattern, sorted set."""
    return sorted_set(F.regexp_extract_all(_col(text), F.lit("(?U)" + K.EMAIL_SIMPLE), 0))


def parse_ignore_list(raw: str | None) -> list[str]:
    """Comma-separated ignore list (environment-variable style)."""
    return [x for x in (raw or "").split(",") if x]


# ---------------------------------------------------------------------------
# context extraction (B)
# ---------------------------------------------------------------------------

def _grouped(pattern: str) -> str:
    """Turn ``(?:^|[^\\d])(N)(?:[^\\d]|$)`` into three capturing groups."""
    return "(?mdU)" + pattern.replace("(?:^|", "(^|").replace("(?:[^\\d]|$)", "([^\\d]|$)")


def _number_core(pattern: str) -> str:
    start = pattern.index("(\\d")
    end = pattern.index(")(?:[^")
    return "(?U)^" + pattern[start:end + 1]


def number_hits(text, pattern: str) -> Column:
    """Every match of a context pattern as ``struct(num, pos)``.

    ``pos`` is the 0-based character offset of the number in ``text``, as a
    sequential left-to-right scan (delimiters consumed) would report it:
    matches are marked in one ``regexp_replace``, the text is split on the
    marks and part lengths are summed.
    """
    t = F.replace(_col(text), F.lit(MARK), F.lit(""))
    marked = F.regexp_replace(t, _grouped(pattern), f"$1{MARK}$2$3")
    core = _number_core(pattern)

    def ends(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s")),
            lambda acc, x: F.struct(
                F.concat(acc["a"], F.array(acc["s"] + F.length(x))).alias("a"),
                (acc["s"] + F.length(x)).alias("s"),
            ),
        )["a"]

    def hits(parts: Column) -> Column:
        return let(ends(parts), lambda cum: F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda x, i: F.struct(
                F.regexp_extract(x, core, 1).alias("num"),
                F.element_at(cum, i + 1).alias("pos"),
            ),
        ))

    # each step is bound: a lambda would compute what it names anew for each hit
    return let(F.split(marked, MARK, -1), hits)


def context_ok(j: Column, words: Column, pos: Column, keywords=None,
               window: int = K.CONTEXT_WINDOW) -> Column:
    """True when a keyword is a whole word near character offset ``pos``.

    ``j`` is the text lower-cased with whitespace collapsed (``collapse_ws``)
    and ``words`` is ``split(j, ' ')``; compute both once per row (see
    ``extract_context``), not once per hit. Word index: the first word whose
    running length (each word plus one) reaches ``pos``, 0 when none does,
    which is the number of blanks in ``j`` before ``pos - 1``. Window:
    ``[index-10, index+10)``.
    """
    kw = keywords if keywords is not None else K.CONTEXT_KEYWORDS
    head = F.substring(j, 1, F.greatest(pos - 1, F.lit(0)))
    spaces = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
    wi = F.when(pos > F.length(j) + 1, F.lit(0)).otherwise(spaces)
    start = F.greatest(wi - window, F.lit(0))
    end = F.least(F.size(words), wi + window)
    win = F.slice(words, start + 1, F.greatest(end - start, F.lit(0)))
    return (F.length(j) > 0) & F.arrays_overlap(win, _lit_array(kw))


def context_numbers(hits: Column, j: Column, words: Column, n_digits: int) -> Column:
    """Numbers of ``number_hits`` that pass the context gate, digits only."""
    kept = F.filter(hits, lambda h: context_ok(j, words, h["pos"]))
    nums = F.transform(kept, lambda h: F.regexp_replace(h["num"], "[^0-9]", ""))
    return F.filter(nums, lambda x: F.length(x) == n_digits)


#: In every number that is kept: its digits are ASCII, and a SIRET starts as a SIREN does.
KEPT_CORE = _number_core(K.SIREN_CONTEXT).removeprefix("(?U)^").replace(r"\d", "[0-9]")


def _context_sets(text: Column, drop_siret_prefix: bool, prefix: str) -> Column:
    """``struct(siret, siren)`` of a text. The delimited patterns, which are slow,
    run where ``KEPT_CORE`` is found, and words are only looked at where there
    is a number."""
    def row(siret: Column, siren: Column) -> Column:
        return F.struct(siret.alias(prefix + "siret"), siren.alias(prefix + "siren"))

    def sets(hits: Column) -> Column:
        def gated(j: Column, words: Column) -> Column:
            sirens = context_numbers(hits["siren"], j, words, 9)

            def dropped(siret: Column) -> Column:
                if not drop_siret_prefix:
                    return row(siret, sorted_set(sirens))
                prefixes = F.transform(siret, lambda x: F.substring(x, 1, 9))
                return row(siret, let(prefixes, lambda p: sorted_set(F.filter(sirens, lambda x: ~F.array_contains(p, x)))))
            return let(sorted_set(context_numbers(hits["siret"], j, words, 14)), dropped)

        some = (F.size(hits["siret"]) > 0) | (F.size(hits["siren"]) > 0)
        return F.when(some, let(collapse_ws(text), lambda j: let(F.split(j, " ", -1), lambda w: gated(j, w)))).otherwise(nothing)

    none = F.array().cast("array<string>")
    nothing = row(none, none)
    hits = F.struct(number_hits(text, K.SIRET_CONTEXT).alias("siret"), number_hits(text, K.SIREN_CONTEXT).alias("siren"))
    possible = F.replace(text, F.lit(MARK), F.lit("")).rlike(KEPT_CORE)
    return F.when(possible, let(hits, sets)).otherwise(nothing)


def extract_context(df, text: str = "text", drop_siret_prefix: bool = True,
                    strip_spaces: bool = False, prefix: str = ""):
    """Add ``siren``, ``siret``, ``emails`` (context rules) to ``df``.

    Narrow: one projection per row, no shuffle. SIRENs equal to the first
    nine digits of an accepted SIRET of the same text are dropped. The numbers
    come out of a generator, below which no later filter on them is copied.
    """
    sets = _context_sets(F.col(text), drop_siret_prefix, prefix)
    out = df.drop(prefix + "siret", prefix + "siren").select("*", F.inline(F.array(sets)))
    return out.withColumn(prefix + "emails", email_rfc(F.col(text), strip_spaces=strip_spaces))


def email_rfc(text, strip_spaces: bool = False) -> Column:
    """De-obfuscate, RFC-5322-style match, lower-case, first-seen order."""
    found = let(deobfuscate_email(text, strip_spaces=strip_spaces), lambda d: F.when(
        F.instr(d, "@") > 0, F.regexp_extract_all(d, F.lit(_email_rfc_iterative()), 0)))
    return F.coalesce(F.array_distinct(F.transform(found, F.lower)), F.array().cast("array<string>"))


# FIXED VALUES (character classes of the RFC pattern in ``keywords.EMAIL_RFC``)
_ATOM = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]"
_QUOTED = r"[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]"
_ESCAPED = r"\\[\x01-\x09\x0b\x0c\x0e-\x7f]"
_LITERAL = r"[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"


def _email_rfc_iterative() -> str:
    """``EMAIL_RFC`` in a spelling that the regex engine runs without recursion
    and in linear time on long tokens; the matches are the same.

    Loops over groups recurse once per turn in this engine, unless possessive.
    They may be: '@' is no atom character, a quoted part's branches differ in
    their first character, and a domain label within the list is followed by a
    dot and an alphanumeric character. A start inside a run of atoms fails where
    the run's own start fails, so only the latter is tried (or the end of the
    previous match). In a domain literal the escape adds only blanks after a
    backslash; a closing bracket is looked for after the last of these.
    """
    first = rf"(?:\G|(?<=\G\.)|(?<!{_ATOM})(?<!{_ATOM}\.))"
    local = rf'(?:{first}{_ATOM}++(?:\.{_ATOM}++)*+|"(?:{_QUOTED}++|{_ESCAPED})*+")'
    names = rf"(?:[a-z0-9][a-z0-9-]*+(?<!-)\.(?=[a-z0-9]))++{_LABEL}"
    literal = rf"\[(?:{_BYTE}\.){{3}}(?:{_BYTE}\]|[a-z0-9-]*[a-z0-9]:(?:{_LITERAL}++(?<=\\)[\x09\x20])*+{_LITERAL}+\])"
    return f"(?i){local}@(?:{names}|{literal})"


def luhn_valid(num) -> Column:
    """Optional checksum flag (an addition; nothing filters on it by default)."""
    return F.luhn_check(_col(num))
