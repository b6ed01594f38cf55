"""Text Column functions: page text, accent folding, e-mail de-obfuscation.

Everything here returns a ``Column`` built from Spark SQL built-ins, so it runs
inside whole-stage codegen with no Python in the task.
"""

from __future__ import annotations

import functools
import html.entities
import unicodedata

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` in the plan, and computed, once however often
    ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _java_class(chars: list[str]) -> str:
    """Compact a set of code points into a Java/RE2 character class body."""
    cps = sorted({ord(c) for c in chars})
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        out.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
        i = j + 1
    return "".join(out)


@functools.lru_cache(maxsize=None)
def whitespace_class() -> str:
    """Characters Python's ``str.split()`` splits on, as a regex class body.

    Generated from ``str.isspace`` so Java and RE2 agree with Python instead
    of using their (different) ASCII/Unicode ``\\s`` definitions.
    """
    return _java_class([chr(c) for c in range(0x3100) if chr(c).isspace()])


@functools.lru_cache(maxsize=None)
def _fold_tables() -> tuple[str, str, str]:
    """(from, to, marks): NFD base letters and combining marks of the BMP.

    Rule: a character whose canonical decomposition is one base character
    plus combining marks maps to that base; characters with a non-zero
    canonical combining class are removed.
    """
    src, dst, marks = [], [], []
    for cp in range(0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        d = unicodedata.normalize("NFD", ch)
        if d == ch:
            continue
        base = "".join(x for x in d if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst), _java_class(marks)


def unaccent(c) -> Column:
    """NFD, drop combining marks, lower-case (accent-insensitive folding)."""
    src, dst, marks = _fold_tables()

    def folded(s: Column) -> Column:  # the tables hold no ASCII, and cost much for each character
        plain = F.regexp_replace(F.translate(s, src, dst), f"[{marks}]+", "")
        return F.lower(F.when(s.rlike(r"[^\x00-\x7F]"), plain).otherwise(s))
    return let(_col(c), folded)


def digits_only(c) -> Column:
    """Keep ASCII digits only."""
    return F.regexp_replace(_col(c), "[^0-9]", "")


def clean_ws(c) -> Column:
    """Newline and tab to space (carriage return kept)."""
    return F.translate(_col(c), "\n\t", "  ")


def collapse_ws(c) -> Column:
    """Lower-case, Python-``split()`` whitespace collapsed to one space, trimmed."""
    ws = whitespace_class()
    s = F.regexp_replace(F.lower(_col(c)), f"[{ws}]+", " ")
    return F.regexp_replace(s, "^ | $", "")


def deobfuscate_email(c, strip_spaces: bool = False) -> Column:
    """Lower-case, then the obfuscation rules in order (``[at]`` -> ``@`` ...).

    ``strip_spaces`` also eats blanks around the bracket forms, so
    ``contact [at] site [dot] fr`` decodes to an address (off by default:
    the reference decoding leaves the blanks).
    """
    s = F.lower(_col(c))
    for pattern, repl in K.OBFUSCATION_RULES:
        if strip_spaces and pattern.startswith("\\"):
            s = F.regexp_replace(s, f" ?{pattern} ?", repl)
        else:  # a plain string, and the text is in lower case
            s = F.replace(s, F.lit(pattern.replace("\\", "")), F.lit(repl))
    return s


# ---------------------------------------------------------------------------
# FIXED VALUES (page text, Catalyst mode): element bodies dropped, tag shape
# ---------------------------------------------------------------------------
DROPPED_ELEMENTS = ["script", "style", "template"]
COMMENT_PATTERN = r"(?s)<!--.*?-->"
TAG_PATTERN = r"<[a-zA-Z/!?][^>]*>"


def dropped_elements_pattern() -> str:
    alts = "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in DROPPED_ELEMENTS)
    return f"(?is){alts}"


@functools.lru_cache(maxsize=None)
def _named_entities() -> tuple[dict[str, dict[str, str]], str]:
    """HTML's named references, from the standard library's table: those that
    end in ``;`` by first letter, and a pattern of the names that may lack it,
    longest first."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        by_letter.setdefault(name[0], {})[name] = value
    short = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return by_letter, "^(?:" + "|".join(short) + ")"


@functools.lru_cache(maxsize=1)
def _entity_tables(gateway: int) -> Column:
    """First letter -> name -> value, built once for a JVM; Spark folds the maps to literals."""
    by_letter, _ = _named_entities()
    cell = [F.lit(x) for letter, names in sorted(by_letter.items()) for x in (letter, "\1".join(names), "\1".join(names.values()))]
    return F.create_map(*[
        x for i in range(0, len(cell), 3)
        for x in (cell[i], F.map_from_arrays(F.split(cell[i + 1], "\1", -1), F.split(cell[i + 2], "\1", -1)))])


def _entity_value(name: Column) -> Column:
    """Value of a name (with its ``;`` if it has one), NULL when unknown; a
    look-up scans the names of one letter."""
    tables = _entity_tables(id(SparkContext._gateway))
    return F.element_at(F.element_at(tables, F.substring(name, 1, 1)), name)


def _code_point(number: Column) -> Column:
    """Character of a numeric reference, as HTML reads it: 0x80-0x9F are those
    of code page 1252; 0, surrogates and what is beyond Unicode are U+FFFD;
    control characters and non-characters vanish. NULL (too long) is U+FFFD."""
    western = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    none = ((number.between(1, 8)) | (number == 11) | number.between(14, 31) | (number == 127)
            | number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    bad = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return (F.when(bad, F.lit("\ufffd")).when(number.between(0x80, 0x9F), F.substr(F.lit(western), (number - 0x7F).cast("int"), F.lit(1)))
            .when(none, F.lit("")).otherwise(char))


def decode_entities(c) -> Column:
    """Character references decoded once, left to right: numeric ones and all of
    HTML's names (without ``;`` where HTML allows, by the longest such name)."""
    _, short = _named_entities()

    def one(p: Column) -> Column:  # what follows an ampersand
        digits = F.regexp_extract(p, "^#([0-9]+)", 1)
        hexa = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+)", 1)
        number = (F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", "").try_cast("int").cast("bigint"))
                  .otherwise(F.when(F.length(F.regexp_replace(hexa, "^0+(?=.)", "")) <= 6, F.conv(hexa, 16, 10).try_cast("bigint"))))
        whole = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]{0,31};", 0)
        legacy = F.regexp_extract(p, short, 0)
        return (F.when((digits != "") | (hexa != ""), F.concat(_code_point(number), F.regexp_replace(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")))
                .when(~p.rlike("^[A-Za-z]"), F.concat(F.lit("&"), p))
                .when(_entity_value(whole).isNotNull(), F.concat(_entity_value(whole), F.substr(p, F.length(whole) + 1)))
                .when(legacy != "", F.concat(_entity_value(legacy), F.substr(p, F.length(legacy) + 1)))
                .otherwise(F.concat(F.lit("&"), p)))

    def decoded(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    # texts without '&' skip all of it
    return let(_col(c), lambda s: F.when(F.instr(s, "&") > 0, let(F.split(s, "&", -1), decoded)).otherwise(s))


def glued_text(html) -> Column:
    """Visible text with each text node stripped before they are glued (what a
    link's label is scored by): ``Mentions <b> légales</b>`` reads
    ``Mentionslégales``."""
    s = F.regexp_replace(_col(html), COMMENT_PATTERN, "")
    s = F.regexp_replace(s, dropped_elements_pattern(), "")
    nodes = F.split(F.regexp_replace(s, TAG_PATTERN, "\x01"), "\x01", -1)
    return F.array_join(F.transform(nodes, lambda n: F.regexp_replace(decode_entities(n), r"(?U)^\s+|\s+$", "")), "")


def page_text(html) -> Column:
    """HTML -> visible text, parts glued with no separator (Catalyst mode).

    Comments and script/style/template bodies go, tags go, entities are
    decoded. ``<td>123456789</td><td>98</td>`` reads ``12345678998``.
    """
    s = F.regexp_replace(_col(html), COMMENT_PATTERN, "")
    s = F.regexp_replace(s, dropped_elements_pattern(), "")
    s = F.regexp_replace(s, TAG_PATTERN, "")
    return decode_entities(s)
