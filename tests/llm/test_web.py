"""URL filters, WARC archives and exact search."""

import fnmatch
import gzip
import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import queries, topk, urls, warc

SF = "/root/testdata/sf0.001"


@given(st.lists(st.text("ab*", max_size=80), min_size=1, max_size=6), st.lists(st.text("ab", max_size=90), min_size=1, max_size=6))
def test_automaton_matches_as_globs_do(globs, texts):
    got = urls.ShiftAnd(globs).matches([t.encode() for t in texts])
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_judge(spark):
    rows = [(1, "http://Sub.Example.ORG/es/x"), (2, "https://example.org/en/12"), (3, "http://a.com/fr/?q"), (4, "http://x.com/y.org/"), (5, None), (6, "no mark"), (7, "http://org/"), (8, "http://example.org?x/"), (9, "http://xorg/"), (None, "ftp://b.com/de/#"), (10, "http://é.org/ü")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert got[1] == ("sub.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == (None, "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2] == "org/" and got[8] == ("example.org", "", None, "allow") and got[9][2] is None and got[None][2] == "com/de/" and got[10][2] == "org/"
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0 and {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


PAGES = [(i, f"http://a/{i}", t) for i, t in enumerate([None, "", "short", "short", "x" * 100, "x" * 100, "é" * 60_000, "é" * 60_000, "y" * 40_000, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 50], 1)] + [(5, "http://a/5", "x" * 100), (None, None, "x" * 100), (None, "u é", "z" * 200)]


def test_archives_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, key string, origin int")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    assert records.filter("record_type = 'continuation'").count() > 0
    rows = warc.decode(warc.reassemble(records)).collect()
    assert len(rows) == len(PAGES) and all(r.error is None for r in rows)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(data) >= 100 else None
        again = first is not None and first != i
        want.append((i or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None if again else data))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.read(spark, str(tmp_path / "w")).count() == records.count()


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.decode(warc.reassemble(warc.read(spark, str(tmp_path / "w")))).count() == 0


def test_damaged_segments_are_told(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc")
    part = lambda n, total, data: ("f", "r", "response" if n == 1 else "continuation", 1 if n == 1 else None, None, None, n, total, data, None)
    whole = spark.createDataFrame([part(1, None, block[:20]), part(2, len(block), block[20:])], warc.RECORD)
    assert bytes(warc.decode(warc.reassemble(whole)).first().payload) == b"abc"
    missing = spark.createDataFrame([part(1, None, block[:20]), part(3, len(block), block[20:])], warc.RECORD)
    short = spark.createDataFrame([part(1, None, block[:20]), part(2, len(block) + 1, block[20:])], warc.RECORD)
    for bad in (missing, short):
        row = warc.decode(warc.reassemble(bad)).first()
        assert row.payload is None and "segments" in row.error


@given(st.binary(max_size=20_000))
def test_chunked_framing(data):
    assert warc.unchunked(warc.chunked(data)) == data


def test_several_gzip_members():
    record = warc._record({"WARC-Type": "response", "WARC-Record-ID": "<x>"}, b"body") + b"\r\n\r\n"
    assert [b for _, b, _ in warc.parse(gzip.compress(record) + gzip.compress(record))] == [b"body"] * 2


def test_archives_of_others(spark, tmp_path):
    """Foreign ids, segments in two files, other types, headers without a space, plain files; damaged and truncated ones give error rows."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\n\r\n"
    gap = b"\r\n\r\n"
    one = b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID:<urn:uuid:1>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length:%d\r\n\r\n" % len(http + b"abc") + http + b"abc"
    info = warc._record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:0>"}, b"software: x")
    block = http + b"long" * 10
    first = warc._record({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:2>", "WARC-Segment-Number": 1}, block[:50])
    second = warc._record({"WARC-Type": "continuation", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Segment-Origin-ID": "<urn:uuid:2>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": len(block)}, block[50:])
    whole = gzip.compress(info + gap + second + gap)
    files = {"a.warc": info + gap + one + gap + first + gap, "b.warc.gz": whole, "c.warc.gz": gzip.compress(one + gap + one * 50)[:-30], "d.warc": b"rubbish\r\n\r\n" + one + gap + b"WARC/1.0\r\nno length\r\n\r\n" + one + gap, "e.warc.gz": b"\x1f\x8bno gzip"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.decode(warc.reassemble(warc.read(spark, str(tmp_path)))).collect()
    assert all(r.page_id is None for r in rows)
    good = sorted(bytes(r.payload) for r in rows if r.error is None)
    assert good.count(b"software: x") == 2 and good.count(b"long" * 10) == 1 and good.count(b"abc") >= 4
    assert all(r.payload is None for r in rows if r.error) and sum(bool(r.error) for r in rows) >= 4


def test_record_ids_differ(spark, tmp_path):
    rows = [(i % 4, "u", f"{i % 4}" * 40_000) for i in range(12)] + [(None, "u", "x")] * 3
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w")).collect()
    heads = [r.record_id for r in records if r.record_type != "continuation"]
    assert len(heads) == len(set(heads)) == 15
    assert warc.decode(warc.reassemble(warc.read(spark, str(tmp_path / "w")))).filter("error IS NULL").count() == 15


def plain_search(rows, k):
    v = {i: np.floor(256 * np.array(x, np.float64)) for i, x in rows}
    out = set()
    for q in (i for i in v if i % 50 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:k]
        out |= {(q, rank, c, -s) for rank, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("group", [2_048, 16])
def test_search_is_exact(spark, monkeypatch, group):
    """Also with many annuli, repeated vectors that fill one and more, and several query blocks."""
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (5 if i % 7 == 0 else 1)).tolist()) for i in range(400)] + [(i, [0.5, -1, 2, 0, 0, 1]) for i in range(400, 520)] + [(i, [0.0] * 6) for i in range(520, 530)]
    table = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = topk.search(topk.integer_vectors(table), F.col("vec_id") % 50 == 0, 5).collect()
    assert {tuple(r) for r in got} == plain_search(rows, 5) and len(got) == 55


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(topk.integer_vectors(table), F.col("vec_id") % 50 == 0, 5).collect()
    each = [(0, 1, 0, 327_680), (0, 2, 1, 196_608), (0, 3, 2, 196_608)]  # the rows with id 0 are candidates of each other
    assert sorted(map(tuple, got)) == sorted(each * 2)
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(topk.integer_vectors(twice), F.col("vec_id") % 50 == 0, 1).collect()] == [(0, 1, 1, 589_824)]
    assert topk.search(topk.integer_vectors(table.limit(0)), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    got, want = (sorted(tuple(str(plain(v)) for v in row) for row in x.astype(object).itertuples(index=False)) for x in (got, want))
    assert got == want and got


@pytest.mark.parametrize("body", [b"1\r\nA\r\n-6\r\n", b"+1\r\nA\r\n0\r\n\r\n", b"0x1\r\nA\r\n0\r\n\r\n", b"1_0\r\nA\r\n", b"\r\n", b"-1\r\n", b"5\r\nA\r\n0\r\n\r\n"])
def test_damaged_chunk_sizes_are_errors(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


def test_scores_are_exact_at_any_magnitude(spark):
    """Sums beyond 2**53 in integers; beyond 64 bits an error."""
    big = 1e6 + 1 / 256
    rows = [(0, [big, 0.0]), (1, [big, 0.0]), (2, [1e6, 0.0]), (3, [big, 1.0]), (4, [-big, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(topk.integer_vectors(table), F.col("vec_id") % 50 == 0, 5).collect()]
    whole = {i: [int(256 * c // 1) for c in v] for i, v in rows}
    scores = sorted((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in range(1, 5))
    assert sorted(got) == [(0, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert -scores[0][0] == 256_000_001**2 and -scores[2][0] == 256_000_001 * 256_000_000
    table = spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.search(topk.integer_vectors(table), F.col("vec_id") % 50 == 0, 5).collect()


def test_bounds_are_held_for_some_queries_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(map(tuple, topk.search(topk.integer_vectors(table), F.col("vec_id") % 5 == 0, 3).collect()))
    monkeypatch.setattr(topk, "VISIT", 7)
    monkeypatch.setattr(topk, "GROUP", 16)
    assert sorted(map(tuple, topk.search(topk.integer_vectors(table), F.col("vec_id") % 5 == 0, 3).collect())) == want
