"""The engine's spelling of the RFC e-mail pattern against the pattern itself."""

import random
import re

from pyspark.sql import functions as F

from crawlfold.functions import extract as E
from crawlfold.functions import keywords as K


def test_same_matches_as_the_pattern(spark):
    rng = random.Random(11)
    pieces = ["a", "b-", "-", ".", "..", "@", "@@", '"', "\\", " ", "[", "]", "1.2.3.4", "[1.2.3.4]", "[1.2.3.x:", "c1", "_", "a.b@c.de",
              '"q"@x.y', "\t", "Z", "é", "@b.c", "x@y.z.", ":"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    texts += ["a@b.c.-x@y.z", "a@b.c_d@e.f", ".a@b.c", "a..b@c.d", "a@b.c-.d", "a@b-.c", "a@-b.c", "x@[1.2.3.4] y", "a@b", "x@[1.2.3.a:b]", "a.@b.c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", F.regexp_extract_all("t", F.lit(E._email_rfc_iterative()), 0).alias("m")).collect()}
    pattern = re.compile(K.EMAIL_RFC, re.I)
    wrong = [(t, got[i], [m[0] for m in pattern.finditer(t)]) for i, t in enumerate(texts) if got[i] != [m[0] for m in pattern.finditer(t)]]
    assert not wrong, wrong[:5]


def test_long_tokens(spark):
    n = 1_000_000
    texts = ['x "' + "l" * n + " y@a.fr", "p" * n + " q@a.fr", "a." * (n // 2) + " q@a.fr", '"' + "\\a" * (n // 2) + '"@a.fr',
             "me@" + "a." * (n // 2) + "fr", "x@[1.2.3.q:" + "z" * n, '"' * n + " q@a.fr", "z" * n]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", E.email_rfc(F.col("t")).alias("e")).collect()}
    assert got[0] == ["y@a.fr"] and got[1] == got[2] == got[6] == ["q@a.fr"] and got[5] == got[7] == []
    assert len(got[3][0]) == n + 7 and len(got[4][0]) == n + 5
