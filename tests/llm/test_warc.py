import base64
import gzip
import hashlib

from equiaudit.llm.common import scratch_path
from equiaudit.llm.warc import _parse, assemble, orphans, pages_through_archives, read_warc, write_warc

SCHEMA = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark):
    html = [None, "", "<p>é</p>", "x" * 300_000, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello",
            "<p>é</p>", "", "same", "same", "same"]
    rows = [(i if i != 8 else None, f"http://h{i}.org/a b\r\nX: y" if i % 2 else None, t) for i, t in enumerate(html)]
    got = pages_through_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), records_per_file=4).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first.setdefault(digest(t), i)
    want = [(i, len((t or "").encode()), digest(t), "response" if i == first[digest(t)] else "revisit",
             None if i == first[digest(t)] else first[digest(t)]) for i, _, t in rows]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert {r["url"] for r in got if r["page_id"] == 1} == {"http://h1.org/a%20b%20%20X:%20y"}


def test_min_revisit_bytes_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMA)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"])
                 for r in pages_through_archives(df, min_revisit_bytes=3).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None),
                   (4, "revisit", 3)]
    assert pages_through_archives(df.limit(0)).collect() == []


def test_payloads_survive_and_nest(spark):
    path = scratch_path(spark, "warc-test")
    write_warc(spark.createDataFrame([(1, "http://a/b?c=d", "<é>\r\n")], SCHEMA), path)
    (c,) = assemble(read_warc(spark, path)).collect()
    assert bytes(c["payload"]) == "<é>\r\n".encode() and c["digest_ok"]
    assert len(c["requests"]) == 1 and c["metadata"][0]["fields"] == {"page_id": "1"}


def record(kind, rid, *to, extra="", block="x"):
    links = "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to)
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{links}{extra}Content-Length: {len(block)}\r\n\r\n"
            f"{block}\r\n\r\n").encode()


def test_links_in_both_directions_and_over_a_request(spark, tmp_path):
    parts = [record("response", "r1", "q1"), record("request", "q1"), record("metadata", "m1", "q1"),
             record("request", "q2", "r2"), record("response", "r2"), record("metadata", "m2", "q2"),
             record("metadata", "lost", "nowhere"), record("resource", "r3")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))  # a member for each record
    records = read_warc(spark, str(tmp_path))
    got = {c["record_id"]: (len(c["requests"] or []), [m["record_id"] for m in c["metadata"] or []])
           for c in assemble(records).collect()}
    assert got == {"<r1>": (1, ["<m1>"]), "<r2>": (1, ["<m2>"]), "<r3>": (0, [])}
    assert [r["record_id"] for r in orphans(records).collect()] == ["<lost>"]


def test_damaged_records():
    whole = record("response", "a")
    assert [r.get("error") for r in _parse(whole + whole[:-8], True)] == [None, "ends early"]
    assert [r.get("error") for r in _parse(b"junk\r\nmore\r\n" + whole, True)] == ["no version line", None]


def test_cut_and_damaged_archives_give_error_rows(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 30000\r\n\r\n" + bytes(
        (7 * i * i) % 251 for i in range(30_000)) + b"\r\n\r\n"
    one, other = gzip.compress(record), gzip.compress(record.replace(b"<a>", b"<b>"))
    assert [r.get("error") for r in _parse(one + other, True)] == [None, None]
    cut = list(_parse(one + other[:-200], True))
    assert cut[0].get("error") is None and cut[-1]["error"] == "archive ends early"
    broken = bytearray(other)
    broken[len(broken) // 2] ^= 0xFF
    hurt = list(_parse(one + bytes(broken), True))
    assert hurt[0].get("error") is None and hurt[-1]["error"]
    assert [r.get("error") for r in _parse(one + b"no gzip member", True)][0] is None
    for name, content in (("whole", one + other), ("cut", one + other[:50]), ("stub", one[:12])):
        (tmp_path / f"{name}.warc.gz").write_bytes(content)
    rows = read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.error is None) == ["<a>", "<a>", "<b>"]
    assert sum(r.error is not None for r in rows) >= 2


def test_pages_with_other_columns(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://h/x", "a"), (2, None, None), (3, "http://h/y", "a")],
                                  "page_id long, url string, html string")
    clash = pages.withColumns({"digest": F.lit(1), "body": F.lit("x"), "row": F.lit(2), "type": F.lit("t")})
    assert sorted(map(str, pages_through_archives(clash).collect())) == sorted(map(str, pages_through_archives(pages).collect()))
