import html
import random

from pyspark.sql import functions as F

from crawlfold.functions.text import decode_entities


def test_decodes_as_html_does(spark):
    rng = random.Random(8)
    names = list(html.entities.html5)
    texts = [f"a&{n}b" for n in names]
    pieces = ["&", "#", "x", ";", "&amp;", "&eacute", "&notit;", "&#64;", "&#x40;", "&#150", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999;",
              "&#x1F600;", "&#8;", "&#xFFFE;", "&ecirc;", "&nosuch;", " ", "12", "é", "&&", "&#xZ;", "&# 5;", "&lt", "&copy2", "&#000065;", "&#x00000041;"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 8))) for _ in range(3000)] + [None, "", "&", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", decode_entities(F.col("t")).alias("d")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert not wrong, (len(wrong), wrong[:6])
    assert got[len(texts) - 4] is None
