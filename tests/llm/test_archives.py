import base64
import gzip
import hashlib
import io

import duckdb
import pytest

from crawlfold.llm import archives as A
from crawlfold.llm.staging import shared_path

BODY = "été\r\n\r\nWARC/1.1\r\n\r\n\n1 0 x\n"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/x y\n", "1.2.3.4", "20011231235958", "text/html", A.http_response(BODY.encode())),
               ("http://b/", "1.2.3.4", "2001", "text/plain", b""), ("http://c/", "", "20010101000000", "image/gif", bytes(range(256)))]
    data = A.arc_file(records, version)
    got = list(A.parse_arc(io.BytesIO(data)))
    assert [r.block for r in got] == [r[4] for r in records]
    assert [r.version for r in got] == [version] * 3 and got[0].fields["URL"] == "http://a/x%20y%0A"
    (h, block), = A.parse_warc(io.BytesIO(A.warc_record(got[0], 5) + b"\r\n"))
    assert h["WARC-Type"] == "response" and block == records[0][4] and h["WARC-Date"] == "2001-12-31T23:59:58Z"
    assert h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(BODY.encode()).digest()).decode()
    (h, block), = A.parse_warc(io.BytesIO(A.warc_record(got[2], 6) + b"\r\n"))
    assert h["WARC-Type"] == "resource" and block == bytes(range(256))
    (h, block), = A.parse_warc(io.BytesIO(A.warc_record(got[0], 7, 5) + b"\r\n"))
    assert h["WARC-Type"] == "revisit" and h["WARC-Refers-To"] == A.record_id("5") and block.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("data", [b"http://x 1 2 3 4\n", A.arc_file([("u", "i", "d", "m", b"12345")])[:-1], A.arc_file([]) + b"\nbad line\n"])
def test_broken_arc_is_an_error(data):
    with pytest.raises(A.ArcError):
        list(A.parse_arc(io.BytesIO(data)))


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, _sha1 int, value string")
    path = shared_path(spark, "test-warc")
    A.write_archives(A.convert_pages(df, **more), path)
    return sorted((tuple(r) for r in A.read_archives(spark, path).collect()), key=str)


def test_pages_to_archives_and_back(spark):
    rows = [(9, "u", BODY, 1, "x"), (3, "u", BODY, 1, "x"), (4, None, None, 1, "x"), (5, "http://a b", "", 1, "x"),
            (6, "u", "x" * 2_000_000, 1, "x"), (3, "u", BODY, 1, "x"), (None, "u", BODY, 1, "x"), (None, "u", "only", 1, "x")]
    got = run(spark, rows)
    def digest(t):
        return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {BODY: 3, "": 4}
    want = []
    for i, u, t, _, _ in rows:
        t = t or ""
        f = first.get(t)
        again = f is not None and f != i
        want.append((i, len(t.encode()), digest(t), "revisit" if again else "response", f if again else None,
                     (u or "-").replace(" ", "%20"), "2020-01-01T00:00:00Z"))
    assert got == sorted(want, key=str)
    assert {r[3] for r in run(spark, rows, min_revisit_bytes=10 ** 9)} == {"response"}
    assert run(spark, []) == []


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = A.query(spark, sf)
    got = sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({A.SQL})").fetchall(), key=str)


def stored(spark, name, files, end="\n"):
    path = shared_path(spark, name)
    A.write_archives(spark.createDataFrame([(f,) for f in files], "value binary"), path, end)
    return path


def test_arc_files_of_many_records(spark):
    """Both versions, bytes that are no UTF-8, a record without an id, equal payloads in two files."""
    gif, latin = bytes(range(256)), A.http_response("é".encode("latin-1"))
    one = A.arc_file([("http://a/", "1.1.1.1", "20010101000000", "image/gif", gif), ("http://b/", "1.1.1.1", "20010101000000", "text/html", latin)])
    two = A.arc_file([("http://c/", "1.1.1.1", "20020101000000", "text/html", A.http_response(gif, source=7)),
                      ("http://d/", "1.1.1.1", "20020101000000", "text/html", A.http_response(gif, source=9)),
                      ("http://e/", "1.1.1.1", "20020101000000", "text/html", latin)], 2)
    path = shared_path(spark, "test-arcs")
    A.write_archives(A.convert_archives(spark, stored(spark, "arcs", [one, two])), path)
    rows = {r["target_uri"][7]: r for r in A.read_archives(spark, path).collect()}
    assert {k: (r["page_id"], r["payload_bytes"], r["refers_to"]) for k, r in rows.items()} == {
        "a": (None, 256, 7), "b": (None, 1, None), "c": (7, 256, None), "d": (9, 256, 7), "e": (None, 1, None)}
    assert {k: r["record_type"] for k, r in rows.items() if k in "acd"} == {"a": "revisit", "c": "response", "d": "revisit"}
    assert sorted(rows[k]["record_type"] for k in "be") == ["response", "revisit"]
    assert {rows[k]["payload_digest"] for k in "acd"} == {A.sha1_base32(gif)} and rows["c"]["warc_date"] == "2002-01-01T00:00:00Z"


def test_archives_are_bounded_by_bytes(spark):
    rows = [(i, "u", f"{i}" + "x" * n) for i, n in enumerate([10, 10, 2500, 9000, 10, 1000, 1000, 1000])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = shared_path(spark, "test-bound")
    A.write_pages(pages, path, archive_bytes=3000)
    sizes = [len(list(A.parse_arc(A._opened(r["content"])))) for r in A._files(spark, path).orderBy("path").collect()]
    assert sum(sizes) == 8 and len(sizes) > 3
    warcs = [r["value"] for r in A.convert_archives(spark, path, archive_bytes=3000).collect()]
    assert all(len(w) <= 3000 or len(list(A.parse_warc(io.BytesIO(w + A.CRLF)))) == 1 for w in warcs)
    back = A.read_arcs(spark, path, blocks=False).collect()
    assert sorted((r["number"], r["payload_bytes"]) for r in back) == [(i, len(t)) for i, _, t in rows]


@pytest.mark.parametrize("change", ["payload", "response"])
def test_wrong_payloads_are_found(spark, change):
    arcs = list(A.parse_arc(io.BytesIO(A.arc_file([("u", "i", "2001", "text/html", A.http_response(b"same", source=i)) for i in (1, 2)]))))
    first, second = A.warc_record(arcs[0], 1), A.warc_record(arcs[1], 2, 1)
    wrong = A.sha1_base32(b"other").encode()
    own = A.sha1_base32(b"same").encode()
    files = first.replace(own, wrong) + b"\r\n" + second if change == "payload" else second
    with pytest.raises(Exception, match="payload digest|no response for"):
        A.read_archives(spark, stored(spark, "wrong", [files], "\r\n")).collect()


def test_archives_are_compressed_at_the_fast_level(spark):
    """The default level made compression the largest part of the query; the level changes sizes, never bytes."""
    words = [hashlib.sha1(b"%d" % i).hexdigest()[:3 + i % 5] for i in range(2000)]
    text = " ".join(words[(i * i * 7919 + i * 31) % 1999] for i in range(60_000)).encode()
    rows = spark.createDataFrame([(text,)], "value binary")

    def content(write):
        path = shared_path(spark, "test-level")
        write(path)
        return bytes(A._files(spark, path).collect()[0]["content"])

    plain = content(lambda p: rows.selectExpr("cast(value as string)").write.option("compression", "gzip").text(p))
    fast = content(lambda p: A.write_archives(rows, p))
    same = content(lambda p: A.write_archives(rows, p, "\n", "DEFAULT_COMPRESSION"))
    assert len(same) == len(plain) and 1.02 * len(plain) < len(fast) < 0.8 * len(text)
    assert gzip.decompress(fast) == text + b"\r\n" and gzip.decompress(same) == text + b"\n"
