"""Costly expressions stand in a plan once, and what is read often is written."""

import crawlfold.plans.pipeline_b as B
from crawlfold.functions.extract import extract_context
from crawlfold.functions.text import deobfuscate_email
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_context_sets_are_worked_out_once_below_a_filter(spark):
    df = spark.createDataFrame([(1, "x")], "k int, text string")
    out = extract_context(df, "text").select("k", F.array_join("siren", ";").alias("siren"), F.array_join("siret", ";").alias("siret"))
    plan = _plan(out.filter((F.col("siren") != "") | (F.col("siret") != "")))
    assert plan.count("regexp_replace") <= 6  # 218 when every mention was a copy


def test_entry_filter_does_not_repeat_its_columns(spark):
    import __spark_entry__ as e

    df = spark.createDataFrame([(1, "a1"), (2, "b"), (3, None)], "k int, t string")
    out = e._nonempty(df.select("k", F.regexp_replace("t", "[^0-9]", "").alias("n")), "n")
    assert _plan(out).count("regexp_replace") == 1
    assert out.collect() == [(1, "1")] and out.columns == ["k", "n"]


def test_context_sets_at_the_edges(spark):
    rows = [("siren 123 456 789 ici",), ("siren 123\x01456789",), ("siren ١٢٣456789",), ("siren 123 456 789 00012 siret 123456789 fin",),
            (None,), ("",), ("sans chiffre siren",), ("siret 12345678900012\nsiren 987-654-321",), ("loin 123456789",)]
    got = [(r.siren, r.siret) for r in extract_context(spark.createDataFrame(rows, "text string").coalesce(1), "text").collect()]
    assert got == [(["123456789"], []), (["123456789"], []), ([], []), ([], ["12345678900012"]),
                   ([], []), ([], []), ([], []), (["987654321"], ["12345678900012"]), ([], [])]


def test_deobfuscation_reads_brackets_as_they_stand(spark):
    df = spark.createDataFrame([("A[AT]b(dot)C [at] at D point e",)], "t string")
    assert df.select(deobfuscate_email("t")).first()[0] == "a@b.c @@d.e"


def test_pipeline_b_reads_written_stages(spark, monkeypatch):
    """The identifiers are read off written pages in all three stages."""
    written, cut = [], B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df, *a: (written.append(df), cut(df, *a))[1])
    static = spark.createDataFrame([("https://a.fr", "<html></html>")], "url string, body string")
    rendered = spark.createDataFrame([("https://a.fr", "siren 123 456 789")], "url string, body string")
    out = B.pipeline_b(spark.createDataFrame([("a.fr",)], "domain string"), static, rendered)
    assert "regexp" not in _plan(written[-1])
    assert [tuple(r) for r in out.ids.collect()] == [("a.fr", "siren", "123456789")]
