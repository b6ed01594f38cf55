import random

import duckdb

from crawlfold.llm import line_dedup as L


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 9, "k") for d, t in rows], "doc_id bigint, text string, n_lines int, form string").repartition(3)


def run(spark, rows, **more):
    out = L.dedup_lines(docs_of(spark, rows), **more)
    assert out.columns == ["doc_id", "text", "form", "n_lines", "dropped_lines"]
    return {r.doc_id: r for r in out.collect()}


def prose(rng, n=12):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_variable_fields_are_generalised(spark):
    rng = random.Random(4)
    users = ["anna", "bob", "carl", "dora", "emil", "finn", "gus", "hana", "ida", "jan", "kim", "lea"]
    rows = [(i, f"{prose(rng)}\nthe session of {u} was closed after {i * 7} seconds by the server\n{prose(rng)}") for i, u in enumerate(users)]
    rows += [(100, "the session of nobody knows what but of another kind entirely here"), (101, prose(rng) + "\n" + prose(rng))]
    got = run(spark, rows)
    for i, t in rows[1:12]:
        assert got[i].text == "\n".join([t.split("\n")[0], t.split("\n")[2]]) and (got[i].n_lines, got[i].dropped_lines) == (3, 1)
    for i, t in [rows[0], *rows[12:]]:  # the first document and clean ones
        assert got[i].text == t and got[i].dropped_lines == 0
    assert run(spark, rows, keep_first=False)[0].dropped_lines == 1
    assert all(r.dropped_lines == 0 for r in run(spark, rows, min_docs=13).values())


def test_lines_with_few_constants_stay(spark):
    rng = random.Random(5)
    rows = [(i, "it was the " + prose(rng, 9)) for i in range(30)]  # one leaf, 3 of 12 constant
    assert all(r.dropped_lines == 0 for r in run(spark, rows).values())


def test_odd_rows(spark):
    line = "all rights are reserved here"
    rows = [(i, line) for i in range(12)] + [(20, None), (21, ""), (22, "\n\n"), (23, f"a b\n{line}\n\n  x  y \n{line}"), (24, "z " * 100_000),
                                             (25, "x" * 300_000 + "1"), (None, line), (3, "another text under one id")]
    out = L.dedup_lines(docs_of(spark, rows + rows[:2])).collect()
    assert len(out) == len(rows) + 2
    got = {(r.doc_id, i): r for i, r in enumerate(out)}
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, []).append(r)
    assert {r.text for r in by[0]} == {line} and {r.text for r in by[1]} == {""} and by[None][0].text == ""
    assert by[20][0].text is None and by[20][0].n_lines == 0
    assert (by[21][0].text, by[21][0].n_lines) == ("", 1) and by[22][0].text == "\n\n"
    assert by[23][0].text == "a b\n\n  x  y " and by[23][0].dropped_lines == 2
    assert by[24][0].text == rows[16][1] and by[25][0].text == rows[17][1]
    assert sorted(r.text for r in by[3]) == ["", "another text under one id"]
    assert L.dedup_lines(docs_of(spark, rows).limit(0)).collect() == []


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = L.query(spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({L.SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=str) == want
    assert sum(r[cols.index("dropped_lines")] for r in want) > 100


def test_word_fields_are_generalised_at_any_size(spark):
    def field(i):  # letters only, so that the field is no number
        return "".join(chr(97 + int(c)) for c in f"{i:03d}")

    for n in (12, 100, 1_000, 10_000):
        rows = [(i, f"the session of user n{field(i % 100)} from city c{field(i // max(n // 100, 1) % 100)} was closed by the server")
                for i in range(n)]
        assert sum(r.dropped_lines for r in run(spark, rows).values()) == n - 1, n
    rows = [(i, f"the session of user n{field(i % 100)} was closed by the server") for i in range(2_000)]
    assert sum(r.dropped_lines for r in run(spark, rows).values()) == 1_999  # one first copy, not one a value


def test_templates_side_by_side_in_one_leaf(spark):
    names = [f"n{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(32)]
    for families, values in ((1, 32), (5, 32), (12, 32), (20, 32), (12, 4)):
        rows = []
        for f in range(families):
            w = [f"f{chr(97 + f)}{x}" for x in "abcd"]
            rows += [(1_000 * f + i, f"on this day the {w[0]} of {names[i % values]} from {names[i * 7 // values % values]} was {w[1]} {w[2]} {w[3]}")
                     for i in range(300)]
        got = run(spark, rows)
        assert [sum(got[1_000 * f + i].dropped_lines for i in range(300)) for f in range(families)] == [299] * families, families


def test_short_lines_recur_exactly_or_not(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng)}\nSign in\nMenu\npage {i}\n\n{chr(97 + i % 26)}{chr(97 + i // 26)} words") for i in range(60)]
    got = run(spark, rows)
    assert got[0].text == rows[0][1]
    for i, t in rows[1:]:
        first, _, _, page, empty, last = t.split("\n")
        assert got[i].text == "\n".join([first, page, empty, last]), i


def test_long_lines_and_other_column_names(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    def field(i):
        return "".join(chr(97 + int(c)) for c in f"{i:03d}")
    rows = [(i, " ".join(field(i) if k % 10 == 5 else w for k, w in enumerate(words))) for i in range(40)]
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id bigint, text string, k1 int, k2 int, drops int, lines int")
    out = L.dedup_lines(df).collect()
    assert sum(r.dropped_lines for r in out) == 39 and {(r.k1, r.k2, r.drops, r.lines) for r in out} == {(1, 2, 3, 4)}


def test_leaf_with_many_documents_keeps_prose_and_smaller_templates(spark):
    rng = random.Random(6)
    rows = [(i, f"it was the {prose(rng, 5)}") for i in range(1_500)]
    rows += [(2_000 + i, "it was the policy of all sites here") for i in range(15)]  # 1 % of its leaf
    words = [prose(rng, 1) for _ in range(20)]  # common words, yet no template
    rows += [(3_000 + i, "here we find " + " ".join(rng.choice(words) for _ in range(3))) for i in range(600)]
    got = run(spark, rows)
    assert {i: r.dropped_lines for i, r in got.items() if r.dropped_lines} == {2_000 + i: 1 for i in range(1, 15)}
