r"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar of a formatted conversation::

    conversation := '<conversation escape=' level '>' LF turn*
    turn         := '### ' role ': ' content '</turn>' LF

``content`` and ``role`` hold neither ``### `` nor ``</turn>``. A conversation is
first rendered as it is (level 0) and parsed again; where the parser does not
recover exactly the source turns, the next level is rendered: control strings
are escaped (``\`` -> ``\\``, ``</turn>`` -> ``\l/turn>``, ``### `` -> ``\h## ``, and
in roles ``:`` -> ``\c``). Every backslash of escaped text starts a pair, so level 1
always reads back; ``round_trip`` states the comparison of the rendering kept.

A conversation is one training example and thus one row; its turns meet in one
task, as its single formatted text requires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: the template's marks
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>"
LEVELS = (0, 1)


def header(level: int) -> str:
    return f"<conversation escape={level}>\n"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    """Reversible; the result holds no control string."""
    return _swap(_swap(_swap(c, "\\", "\\\\"), TURN_END, "\\l" + TURN_END[1:]), TURN_START, "\\h" + TURN_START[1:])


def unescape(c: Column) -> Column:
    """Inverse of ``escape`` (and of the role's ``\\c``): what stands between
    escaped backslashes holds only whole pairs."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: _swap(_swap(_swap(p, "\\l", "<"), "\\h", "#"), "\\c", ":")), "\\")


def render(turns: Column, level: int) -> Column:
    """Formatted text of ``turns`` (array of role, text)."""
    def one(t: Column) -> Column:
        role, text = t["role"], t["text"]
        if level:
            role, text = _swap(escape(role), ":", "\\c"), escape(text)
        return F.concat(F.lit(TURN_START), role, F.lit(ROLE_END), text, F.lit(TURN_END + "\n"))
    return F.concat(F.lit(header(level)), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column, level: int) -> Column:
    """Turns of a formatted text as (role, text, skip, take), or a null turn
    where it breaks the grammar. ``skip`` and ``take`` are the characters before
    and in the content, the step from which a loss mask is made."""
    body = F.substr(formatted, F.lit(len(header(level)) + 1))
    pieces = F.split(body, TURN_END + "\\n", -1)

    def one(p: Column) -> Column:
        head = F.substring_index(p, ROLE_END, 1)
        content = F.substr(p, F.length(head) + len(ROLE_END) + 1)
        rest = F.substr(p, F.lit(len(TURN_START) + 1))
        sound = (p.startswith(TURN_START) & F.contains(p, F.lit(ROLE_END))
                 & ~F.contains(rest, F.lit(TURN_START)) & ~F.contains(rest, F.lit(TURN_END)))
        role = F.substr(head, F.lit(len(TURN_START) + 1))
        read = unescape if level else (lambda c: c)
        return F.when(sound, F.struct(
            read(role).alias("role"), read(content).alias("text"),
            (F.length(head) + len(ROLE_END)).cast("bigint").alias("skip"), F.length(content).cast("bigint").alias("take")))
    whole = F.element_at(pieces, -1) == ""
    return F.when(whole, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one))


def _same(parsed: Column, source: Column) -> Column:
    plain = F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(plain == source, F.lit(False))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv, formatted, escape_level, round_trip, turns, loss_mask)`` per
    conversation.

    ``turns`` are those read back from ``formatted``; ``loss_mask`` lists, turn
    by turn, how many characters after the previous turn's end do not bear loss
    (``skip``) and how many then do (``take``, 0 for other roles). Rows are
    ordered by turn, null first, ties by role and text; repeated rows are
    repeated turns; null roles and texts are empty; null conversation ids form
    one conversation; other columns are not read.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col), row.alias("_row")).groupBy(conv_col).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    source = F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = grouped.select(conv_col, source.alias("_source"))
    out = out.withColumn("_r0", render(F.col("_source"), 0))
    out = out.withColumn("_p0", parse(F.col("_r0"), 0))
    out = out.withColumn("_ok", _same(F.col("_p0"), F.col("_source")))
    out = out.withColumn("formatted", F.when(F.col("_ok"), F.col("_r0")).otherwise(render(F.col("_source"), 1)))
    out = out.withColumn("turns", F.when(F.col("_ok"), F.col("_p0")).otherwise(parse(F.col("formatted"), 1)))
    return out.select(
        conv_col, "formatted", F.when(F.col("_ok"), 0).otherwise(1).alias("escape_level"),
        _same(F.col("turns"), F.col("_source")).alias("round_trip"), "turns",
        F.transform("turns", lambda t: F.struct(
            t["skip"].alias("skip"), F.when(t["role"] == loss_role, t["take"]).otherwise(F.lit(0).cast("bigint")).alias("take"))).alias("loss_mask"))


def loss_text() -> Column:
    """Text of ``formatted`` under ``loss_mask``, unescaped. The content's closing
    marks end in the one line feed that the mask does not count, so the text is cut
    at them: of each turn's piece, ``take`` characters behind ``skip``."""
    body = F.when(F.col("escape_level") == 0, F.substr("formatted", F.lit(len(header(0)) + 1))).otherwise(
        F.substr("formatted", F.lit(len(header(1)) + 1)))
    pieces = F.split(body, TURN_END + "\\n", -1)
    cuts = F.zip_with(pieces, "loss_mask", lambda p, m: F.substr(p, (m["skip"] + 1).cast("int"), m["take"].cast("int")))
    raw = F.array_join(cuts, "")  # the piece behind the last turn has no mask: null, left out
    return F.when(F.col("escape_level") == 0, raw).otherwise(unescape(raw))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digest columns of the contract, all read back from ``formatted``."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = loss_text()
    return formatted.select(
        conv_col, F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
        "escape_level", "round_trip")


# FIXED VALUES: the added conversation of the contract
PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return digests(format_conversations(rows.unionByName(probe)))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, contains(text, '### ') OR contains(text, '</turn>') OR contains(role, '### ')
            OR contains(role, '</turn>') OR contains(role, ': ') AS clash,
         length(replace(replace(replace(text, '\', '\\'), '</turn>', '\l/turn>'), '### ', '\h## '))
         + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\l/turn>'), '### ', '\h## '), ':', '\c')) AS escaped_len
  FROM rows
), conv AS (
  SELECT conv_id, count(*) AS n_turns, bool_or(clash) AS clash,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(text) + length(role)) AS raw_len, sum(escaped_len) AS escaped_len
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (length('<conversation escape=0>') + 1 + 14 * n_turns + CASE WHEN clash THEN escaped_len ELSE raw_len END)::BIGINT AS formatted_chars,
       CASE WHEN clash THEN 1 ELSE 0 END::INTEGER AS escape_level, TRUE AS round_trip
FROM conv
"""
