import base64
import gzip
import hashlib

from kinblock.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    pay = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in pay:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    b32 = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    return [(i, len(p), b32(p), *(("response", None) if first.get(p, i) == i else ("revisit", first[p]))) for i, p in pay]


def key(r):
    return tuple(-1 if v is None else v for v in r)


ROWS = [
    (1, "u", "a\r\n\r\nWARC/1.1\r\nb"), (2, "two\nlines", "\r\n"), (3, None, None), (4, "q", "x\r\n\r\n" * 700000), (5, "q", "x\r\n\r\n" * 700000),
    (6, "", "x\r\n"), (7, "", "\r\n\r\n"), (8, "", "\r\n\r\n\r"), (None, "", "zz"), (None, "", "zz"), (9, "", "zz"), (9, "", "zz"), (10, "", "é漢"), (11, "", ""),
    (None, "", "alone"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS sha", "2 AS payload", "3 AS first", "4 AS value")
    for parts in (1, 3):
        assert sorted(map(key, warc.op8(pages.repartition(parts)).collect())) == sorted(map(key, brute(ROWS)))
    assert warc.op8(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_warc(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    n, segments = 0, 0
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert size <= warc.CHUNK and data[size : size + 4] == b"\r\n\r\n"
        data = data[size + 4 :]
        n += fields["WARC-Type"] != "continuation"
        segments += "WARC-Segment-Number" in fields
    assert n == len(ROWS) and segments == 4  # 3.5 MB in chunks of 1 MiB


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "w"
    path.mkdir()
    sha = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    record = warc.segment(1, "u", 0, 1, 7, b"payload", sha).replace(b"payload", b"paYload")
    (path / "a.txt.gz").write_bytes(gzip.compress(record + warc.END))
    try:
        warc.read(spark, str(path)).collect()
    except Exception as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError("damage went unnoticed")


def test_records_are_chunk_rows(spark):
    """Rows (record, chunk) with the digest so far, in order; small chunks, so that records cross many batches and files."""
    text = "0123456789é" * 50
    pages = spark.createDataFrame([(k, "u", text + str(k)) for k in range(40)] + [(99, "u", text + "7")], SCHEMA)
    rows = warc.records(pages.coalesce(1), chunk=100).collect()
    own = [r for r in rows if r.record_id == 7]
    data = (text + "7").encode()
    assert [r.chunk for r in own] == list(range(-(-len(data) // 100)))
    assert [r.digest_so_far for r in own] == [base64.b32encode(hashlib.sha1(data[: 100 * (k + 1)]).digest()).decode() for k in range(len(own))]
    assert [(r.record_id, r.chunk) for r in rows if r.record_id == 99] == [(99, 0)]


def test_small_chunks_round_trip(spark, tmp_path):
    rows = [(k, "u", ("é漢\r\n\r\nx" * (k % 90))) for k in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.write(pages, str(tmp_path / "w"), chunk=64)
    assert sorted(map(key, warc.read(spark, str(tmp_path / "w")).collect())) == sorted(map(key, brute(rows)))
