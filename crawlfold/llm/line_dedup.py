"""Line dedup by a log-template tree (DataFrame functions only).

The tree has a fixed depth: a line goes to the leaf of its token count and its
first ``LEADING`` tokens, where a token with a digit counts as variable. Within a
leaf lines are told apart by what their tokens share, not by how large the leaf or
the corpus is. A token is a constant of its position if it recurs there (in
``min_docs`` documents of the leaf) and goes with another position of its line:
of the documents that have the other token there, at least ``TOGETHER`` have both.
The words of one template go with each other, whichever values its fields take
and however many templates stand beside it in the leaf; a field's value goes with
nothing. Leading tokens are constants of their leaf. The others are variable
fields, and the line's template is what remains.

A template with at least half its tokens constant, and half of those behind the
leading ones (which say nothing within a leaf), that recurs in ``min_docs``
documents is dropped everywhere but in the first document that has it. Lines of
fewer than ``LEADING`` tokens are all leaf: they recur exactly or not at all.

A line is compared at no more than ``ANCHORS`` positions beside its leading ones
(dealt over the line by a rule of the position), so a long line costs
a multiple of its length, not its square. Lines travel as hashes; only lines of
leaves that recur move as text. Hot leaves and templates are pre-aggregated on
distinct lines, and what they are joined to is a table of one row a key, so
Spark can split the hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm.staging import free, stage, unused

LEADING = 3  # leading tokens that lead to a leaf
MIN_DOCS = 10  # documents that make a template or a constant recur
SIMILARITY = 0.5  # share of constant tokens that a template needs
TOGETHER = 0.5  # share of the documents of one token that have the other too
ANCHORS = 16  # positions that others are compared with
VARIABLE = "<*>"
GAP = r"[\x20\x09-\x0D]+"


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, GAP, -1), lambda t: t != "")


def masked(toks: Column) -> Column:
    """A token with a digit is a variable field from the start."""
    return F.transform(toks, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, k1, k2, _text)``: a document is the pair of an id and a text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.lit(1), id_col, text).alias("k1"),
                       F.xxhash64(F.lit(2), text, id_col).alias("k2"), text.alias("_text"))


def _lines(rows: DataFrame) -> DataFrame:
    """Lines with a token at least, and their leaf."""
    lines = rows.select("_id", "k1", "k2", F.posexplode(F.split("_text", "\n", -1)).alias("at", "line"))
    lines = lines.select("_id", "k1", "k2", "at", F.explode(F.array(tokens(F.col("line")))).alias("toks"))
    lines = lines.filter(F.size("toks") > 0)
    return lines.withColumn("leaf", F.xxhash64(F.size("toks"), masked(F.slice("toks", 1, LEADING))))


def templates(rows: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(occurrences, templates)`` of keyed ``rows``: ``(_id, k1, k2, at, form)``
    of the lines in recurring leaves, and ``(form, template, n_tokens,
    constants)`` of their distinct masked lines."""
    lines = _lines(rows)
    leaves = lines.select("leaf", "k1", "k2").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
    leaves = stage(leaves.filter(F.col("docs") >= min_docs).select("leaf"), "leaves")
    found = lines.join(leaves, "leaf", "left_semi").select("_id", "k1", "k2", "at", "leaf", masked(F.col("toks")).alias("toks"))
    found = stage(found.withColumn("form", F.xxhash64("toks")), "leaf-lines")
    free(leaves)

    distinct = found.select("leaf", "form", "k1", "k2").distinct().groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("docs"))
    texts = found.select("form", "toks").dropDuplicates(["form"])
    forms = stage(distinct.join(texts, "form"), "forms")
    # tokens behind the leading ones that recur at their place in the leaf
    places = forms.select("leaf", "form", "docs", F.posexplode("toks").alias("place", "token"))
    places = places.filter((F.col("place") >= LEADING) & (F.col("token") != VARIABLE)).select(
        "leaf", "form", "docs", "place", F.xxhash64("token").alias("token"))
    often = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs)
    often = stage(often, "recurring-tokens")
    recurring = stage(places.join(often, ["leaf", "place", "token"]).groupBy("leaf", "form", "docs").agg(
        F.collect_list(F.struct("place", "token", "n")).alias("own")), "recurring-places")
    # pairs of them in a form, the second at one of the places that the leaf is compared at
    anchor = F.slice(F.array_sort(F.transform("own", lambda o: F.struct(
        (o["place"].cast("bigint") * 7919 % 10007).alias("h"), o["place"].alias("place"), o["token"].alias("token"), o["n"].alias("n")))), 1, ANCHORS)
    sizes = forms.groupBy("leaf").agg(F.sum("docs").alias("size"))
    here = recurring.join(sizes, "leaf").withColumn("anchors", anchor)
    # tokens that both stand in so much of their leaf that they must go together need no count
    sure = lambda o: F.exists("anchors", lambda b: (b["place"] != o["place"]) & (o["n"] + (1 - TOGETHER) * b["n"] >= F.col("size")))
    here = stage(here.select("leaf", "form", "docs", "anchors", F.filter("own", lambda o: ~sure(o)).alias("own"),
                             F.transform(F.filter("own", sure), lambda o: o["place"]).alias("sure")), "compared-places")
    pairs = here.select("leaf", "form", "docs", F.explode("own").alias("a"), "anchors").select(
        "leaf", "form", "docs", "a.place", "a.token", F.explode("anchors").alias("b")).filter(F.col("place") != F.col("b.place"))
    pairs = pairs.select("form", "docs", "place", F.col("b.n").alias("n"),
                         F.xxhash64("leaf", "place", "token", "b.place", "b.token").alias("pair"))
    both = pairs.groupBy("pair").agg(F.sum("docs").alias("both"))
    held = pairs.join(stage(both, "pairs"), "pair").filter(F.col("both") >= TOGETHER * F.col("n"))
    held = here.filter(F.size("sure") > 0).select("form", F.explode("sure").alias("place")).unionByName(held.select("form", "place"))
    held = stage(held.groupBy("form").agg(F.collect_set("place").alias("held")), "constants")
    free(often, recurring, here)

    toks = F.transform("toks", lambda t, i: F.when((i < LEADING) | F.array_contains(F.coalesce("held", F.array().cast("array<int>")), i), t).otherwise(F.lit(VARIABLE)))
    made = forms.join(held, "form", "left").select("form", toks.alias("toks"), F.size("toks").alias("n_tokens"))
    constant = F.filter("toks", lambda t: t != VARIABLE)
    behind = F.size(F.filter(F.slice("toks", LEADING + 1, F.col("n_tokens")), lambda t: t != VARIABLE))
    made = made.select("form", F.concat_ws(" ", "toks").alias("template"), "n_tokens", F.size(constant).alias("constants"), behind.alias("behind"))
    enough = F.when(F.col("n_tokens") < LEADING, F.col("n_tokens")).otherwise(similarity * F.col("n_tokens"))
    made = made.filter((F.col("constants") >= enough) & (F.col("behind") >= similarity * (F.col("n_tokens") - LEADING)))
    made = stage(made.drop("behind"), "templates")
    free(forms, held)
    return found.select("_id", "k1", "k2", "at", "form"), made


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                similarity: float = SIMILARITY, keep_first: bool = True,
                added: tuple[str, str] = ("n_lines", "dropped_lines")) -> DataFrame:
    """``docs`` with recurring template lines dropped from the text, and the
    numbers of lines and of dropped ones in columns named ``added`` (columns of
    these names are replaced).

    Lines end at line feeds; those without a token always stay, and kept lines
    stay as they are. Other columns may have any names. The first document of a template is
    that of the smallest id (nulls last, ties by a hash of the text); it keeps
    all its lines, and with ``keep_first`` off it loses them too. Rows that repeat id and text are one
    document and get the same text. Null texts stay null with 0 lines; an empty
    text is one empty line; a document whose lines are all dropped has an empty
    text; every row stays.
    """
    rows = keyed(docs, id_col, text_col)
    found, made = templates(rows, min_docs, similarity)
    used = found.join(made.select("form", F.xxhash64("template", "n_tokens").alias("template")), "form")
    used = stage(used.select("template", "_id", "k1", "k2", "at"), "template-lines")
    holder = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("k1"), F.col("k2"))
    per_doc = used.select("template", holder.alias("holder")).distinct()
    recurring = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("holder").alias("first"))
    recurring = stage(recurring.filter(F.col("docs") >= min_docs).select("template", "first.k1", "first.k2").withColumnsRenamed(
        {"k1": "f1", "k2": "f2"}), "recurring")
    drops = used.join(recurring, "template")
    if keep_first:
        drops = drops.filter((F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2")))
    base = docs.drop(*added)
    text = F.col(text_col).cast("string")
    k1, k2, gone, cut = (unused(base, c) for c in ("k1", "k2", "drops", "lines"))
    drops = drops.groupBy("k1", "k2").agg(F.collect_set("at").alias(gone))  # line numbers of one document
    own = base.withColumn(k1, F.xxhash64(F.lit(1), id_col, text)).withColumn(k2, F.xxhash64(F.lit(2), text, id_col))
    drops = stage(drops.withColumnsRenamed({"k1": k1, "k2": k2}), "dropped-lines")
    joined = own.join(drops, [k1, k2], "left")
    lines = F.split(text, "\n", -1)
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    # a generated column: the lines are split once, not for every line kept
    split = joined.withColumn(cut, F.explode(F.array(F.when(F.col(gone).isNotNull(), lines))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone)
    shorter = F.array_join(F.transform(kept, lambda i: F.get(cut, i)), "\n")
    return split.select(
        *[(F.when(F.col(gone).isNull(), F.col(c)).otherwise(shorter).alias(c) if c == text_col else F.col(c)) for c in base.columns],
        n.cast("bigint").alias(added[0]), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(added[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without recurring template lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "dropped_lines")


# the same tree on strings; documents have distinct ids there
SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS ln, unnest(string_split(text, chr(10))) AS line FROM documents
), tok AS (
  SELECT doc_id, ln, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS raw FROM lines
), leafed AS (
  SELECT doc_id, ln, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) AS toks,
         len(raw) AS n FROM tok WHERE len(raw) > 0
), leaf AS (
  SELECT n, toks[1:{LEADING}] AS head FROM leafed GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), found AS (
  SELECT f.doc_id, f.ln, f.n, l.head, f.toks FROM leafed f JOIN leaf l ON f.n = l.n AND f.toks[1:{LEADING}] = l.head
), forms AS (
  SELECT n, head, toks, count(DISTINCT doc_id) AS docs FROM found GROUP BY ALL
), places AS (
  SELECT * FROM (SELECT n, head, toks, docs, unnest(range(0, n))::INT AS place, unnest(toks) AS token FROM forms) WHERE place >= {LEADING} AND token <> '{VARIABLE}'
), often AS (
  SELECT n, head, place, token, sum(docs) AS c FROM places GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}
), here AS (
  SELECT p.*, o.c FROM places p JOIN often o USING (n, head, place, token)
), pairs AS (
  SELECT a.n, a.head, a.toks, a.docs, a.place, a.token, b.place AS place_b, b.token AS token_b, b.c
  FROM here a JOIN (SELECT *, row_number() OVER (PARTITION BY n, toks ORDER BY place::BIGINT * 7919 % 10007, place) AS k FROM here) b
    ON a.n = b.n AND a.toks = b.toks AND a.place <> b.place AND b.k <= {ANCHORS}
), pair_docs AS (
  SELECT n, head, place, token, place_b, token_b, sum(docs) AS together FROM pairs GROUP BY ALL
), held AS (
  SELECT DISTINCT p.toks, p.place FROM pairs p JOIN pair_docs t USING (n, head, place, token, place_b, token_b) WHERE t.together >= {TOGETHER} * p.c
), marked AS (
  SELECT toks, list(place) AS places FROM held GROUP BY toks
), shaped AS (
  SELECT f.toks, f.n, list_transform(range(0, f.n), lambda i: CASE WHEN i < {LEADING} OR list_contains(coalesce(m.places, []), i::INT) THEN f.toks[i + 1] ELSE '{VARIABLE}' END) AS shape
  FROM forms f LEFT JOIN marked m ON f.toks = m.toks
), made AS (
  SELECT toks, n, array_to_string(shape, ' ') AS template FROM shaped
  WHERE len(list_filter(shape, lambda t: t <> '{VARIABLE}')) >= CASE WHEN n < {LEADING} THEN n ELSE {SIMILARITY} * n END
    AND len(list_filter(shape[{LEADING + 1}:], lambda t: t <> '{VARIABLE}')) >= {SIMILARITY} * (n - {LEADING})
), used AS (
  SELECT m.template, m.n, f.doc_id, f.ln FROM found f JOIN made m ON f.toks = m.toks
), recurring AS (
  SELECT template, n, min(doc_id) AS first_id FROM used GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), drops AS (
  SELECT DISTINCT u.doc_id, u.ln FROM used u JOIN recurring r ON u.template = r.template AND u.n = r.n WHERE u.doc_id <> r.first_id
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (d.ln IS NULL), '') AS text,
         count(*) AS n_lines, count(d.ln) AS dropped_lines
  FROM lines l LEFT JOIN drops d ON l.doc_id = d.doc_id AND l.ln = d.ln GROUP BY l.doc_id
)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE kept.text END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dropped_lines, 0)::BIGINT AS dropped_lines
FROM documents LEFT JOIN kept USING (doc_id)
"""
