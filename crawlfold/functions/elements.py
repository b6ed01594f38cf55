"""Element scope as Column functions: a page becomes an array of tokens, each
with the marks of all elements that are open around it.

The tokens are start tags, end tags, text, and inert ones (comments,
declarations, and scripts and styles whole). A fold over them keeps the
stack of open elements: a start tag opens one (void and self-closed ones aside),
an end tag closes the last open element of its name and whatever is still open
inside, and is ignored when there is none. Marks are bits that a function gives
to start tags; a stack entry holds its own and those of all elements around it,
so a token's scope is one look at the top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlfold.functions import keywords as K
from crawlfold.functions.text import decode_entities, let, whitespace_class

# ---------------------------------------------------------------------------
# FIXED VALUES (HTML: elements without content)
# ---------------------------------------------------------------------------
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style"]

TOKEN_RE = ("(?is)<!--.*?-->|" + "|".join(rf"<{n}\b[^>]*+>.*?</{n}\s*>" for n in RAW)
            + r"""|<[a-z/!?](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|[^<]++|<""")
NAME_RE = r"^</?([a-zA-Z][^\s/>]*)"
SELF_CLOSED_RE = r"(?:[\s\"']|^<[a-zA-Z][^\s/>]*)/>$"
STEP = 256  # tokens folded into a list of their own, so that lists copied at each token stay short

Marks = Callable[[Column, Column], Column]


def attr_source(tag: Column, name: str) -> Column:
    """An attribute's value as it is written in a start tag, quotes included; ``''`` when absent."""
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)


def _token(t: Column, marks: Marks) -> Column:
    def named(name: Column) -> Column:
        raw = name.isin(*RAW)
        opens = (name != "") & ~t.startswith("</")
        stays = opens & ~name.isin(*VOID) & ~raw & ~t.rlike(SELF_CLOSED_RE)
        return F.struct(
            t.alias("tok"), name.alias("name"),
            F.when(opens & ~raw, F.lit(1)).when(t.startswith("</") & (name != ""), F.lit(-1)).otherwise(F.lit(0)).alias("kind"),
            stays.alias("stays"), (raw | t.rlike("^<[!?]")).alias("inert"),
            F.when(stays, marks(t, name)).otherwise(F.lit(0).cast("bigint")).alias("own"))
    return let(F.lower(F.regexp_extract(t, NAME_RE, 1)), named)


def _above(tokens: Column) -> Column:
    """The marks around each token."""
    stack = F.array().cast("array<struct<name:string,marks:bigint>>")
    none = F.array().cast("array<bigint>")

    def top(stack: Column) -> Column:
        return F.coalesce(F.get(stack, F.size(stack) - 1)["marks"], F.lit(0).cast("bigint"))

    def step(acc: Column, t: Column) -> Column:
        now = acc["stack"]
        opened = F.concat(now, F.array(F.struct(t["name"].alias("name"), top(now).bitwiseOR(t["own"]).alias("marks"))))
        back = F.array_position(F.reverse(F.transform(now, lambda s: s["name"])), t["name"]).cast("int")
        closed = let(back, lambda b: F.when(b > 0, F.slice(now, F.lit(1), F.size(now) - b)).otherwise(now))
        after = F.when(t["stays"], opened).when(t["kind"] == -1, closed).otherwise(now)
        return F.struct(after.alias("stack"), F.concat(acc["out"], F.array(top(now))).alias("out"))

    def some(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(tokens, i * STEP + 1, F.lit(STEP)), F.struct(acc["stack"].alias("stack"), none.alias("out")), step)
        return let(part, lambda x: F.struct(x["stack"].alias("stack"), F.concat(acc["out"], x["out"]).alias("out")))

    steps = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(stack.alias("stack"), none.alias("out")), some)["out"]


def elements(html: Column, marks: Marks) -> Column:
    """Tokens of a page in order, ``struct(tok, name, kind, inert, above)``: ``kind``
    is 1 for a start tag, -1 for an end tag, else 0; ``above`` the marks of the
    elements open around it. ``marks`` gives a start tag and its name a bigint."""
    def scoped(tokens: Column) -> Column:
        return F.zip_with(tokens, _above(tokens), lambda t, m: F.struct(
            t["tok"].alias("tok"), t["name"].alias("name"), t["kind"].alias("kind"), t["inert"].alias("inert"), m.alias("above")))
    return let(F.transform(F.regexp_extract_all(html, F.lit(TOKEN_RE), 0), lambda t: _token(t, marks)), scoped)


# ---------------------------------------------------------------------------
# page text by zones
# ---------------------------------------------------------------------------

def _zone_marks(tag: Column, name: Column) -> Column:
    """One bit for a footer element, then one for each word in class and in id."""
    def within(attr: str, word: str, bit: int) -> Column:
        return F.when(F.contains(attr_source(tag, attr), F.lit(word)), F.lit(1 << bit)).otherwise(F.lit(0))
    out = F.when(name == K.ZONE_FOOTER, F.lit(1)).otherwise(F.lit(0))
    for i, word in enumerate([K.ZONE_FOOTER, *K.ZONE_WORDS]):
        out = out + within("class", word, 2 * i + 1) + within("id", word, 2 * i + 2)
    return F.when(tag.rlike(r"(?i)\s(class|id)\s*="), out).otherwise(F.when(name == K.ZONE_FOOTER, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _unquoted(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2"))


def clean_text(html: Column) -> Column:
    """Text of a page by zones, each repeated on purpose: descriptions and keywords
    of its metas, footers, elements whose class or id holds a legal word, then all
    of the page (scripts and styles too); whitespace collapsed, characters that
    do not print removed."""
    def meta(e: Column, attr: str, value: str) -> Column:
        tags = F.filter(e, lambda t: (t["name"] == "meta") & (F.regexp_replace(attr_source(t["tok"], attr), "^[\"']|[\"']$", "") == value))
        return F.transform(tags, lambda t: _unquoted(attr_source(t["tok"], "content")))

    def text_of(t: Column) -> Column:
        raw = F.regexp_extract(t["tok"], r"(?s)^<[^>]*>(.*)</[^<]*$", 1)
        return F.when(t["inert"], F.when(t["name"] != "", raw).otherwise(F.lit(""))).otherwise(decode_entities(t["tok"]))

    def zones(e: Column) -> Column:
        texts = F.transform(F.filter(e, lambda t: t["kind"] == 0), lambda t: F.struct(text_of(t).alias("text"), t["above"].alias("above")))

        def joined(texts: Column) -> Column:
            parts = [meta(e, a, v) for a, v in K.ZONE_METAS]
            for bit in range(2 * len(K.ZONE_WORDS) + 3):
                parts.append(F.transform(_with_bit(texts, bit), lambda t: t["text"]))
            return F.array_join(F.concat(*parts, F.transform(texts, lambda t: t["text"])), " ")
        return let(texts, joined)

    s = F.regexp_replace(let(elements(html, _zone_marks), zones), f"[{whitespace_class()}]+", " ")
    return F.regexp_replace(F.regexp_replace(s, "^ | $", ""), r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]", "")


def _with_bit(texts: Column, bit: int) -> Column:
    return F.filter(texts, lambda t: t["above"].bitwiseAND(F.lit(1 << bit).cast("bigint")) > 0)
