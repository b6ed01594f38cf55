import hashlib

import duckdb
from pyspark.sql import functions as F

from crawlfold.llm import chat

ODD = ["", None, "plain", "\\", "\\l/turn>", "</turn>", "</turn>\n### user: x", "### ", "#### x", "a\\\\</turn>\\h", "</tur", "### Assistant: ",
       "x" * 50000, "\\### Assistant: </turn> ok", "<</turn>>\n", "é\U0001f600", "\\c:\\l\\h", "<conversation escape=0>\n", "\\\\\\</turn>"]


def rows_of(spark, convs):
    rows = [(c, i, r, t, "z") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, formatted string")


def brute(turns):
    lines = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_odd_texts(spark):
    convs = {i: [("user", t), ("assistant", t)] for i, t in enumerate(ODD)}
    convs[100] = [("user", a) if k % 2 else ("assistant", a) for k, a in enumerate(ODD)]
    convs[101] = [("a: b", "x"), (None, "y"), ("### r</turn>", "z"), ("c:", ": q")]
    convs[102] = [("assistant", "same"), ("assistant", "same")]
    f = chat.format_conversations(rows_of(spark, convs)).cache()
    got = {r.conv_id: r for r in chat.digests(f).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert r.round_trip, c
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(turns), c
    assert got[2].escape_level == 0 and got[5].escape_level == 1 and got[101].escape_level == 1
    # the mask alone finds the loss text in the formatted text
    r = f.filter("conv_id = 100").collect()[0]
    at, loss = len(chat.header(r.escape_level)), []
    for m in r.loss_mask:
        at += m.skip
        whole = r.formatted.index("</turn>\n", at)
        loss.append(r.formatted[at:at + m.take])
        assert m.take in (0, whole - at)
        at = whole + len("</turn>\n")
    assert at == len(r.formatted)
    assert "</turn>" not in "".join(loss) and "### " not in "".join(loss)


def test_order_ties_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "a"), (None, 1, "assistant", "c")],
                               "conv_id bigint, turn int, role string, text string")
    r = chat.format_conversations(df).collect()
    assert len(r) == 1 and [t.text for t in r[0].turns] == ["a", "c", "b"]
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_query_matches_its_sql(spark, tmp_path):
    convs = {i: [("system", "s"), ("user", t), ("assistant", (t or "") + "!")] for i, t in enumerate(ODD)}
    rows_of(spark, convs).drop("formatted").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = chat.query(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cols = ", ".join(sorted(df.columns))
    assert got == sorted(con.execute(f"SELECT {cols} FROM ({chat.SQL})").fetchall())
    assert any(r[0] == -7 for r in chat.query(spark, str(tmp_path)).select("conv_id").collect())
    assert not df.filter(~F.col("round_trip")).count()
