import hashlib

import pytest

from finescale.llm import shared, warc

LONG = "long é " * 9000 + "WARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" + "x" * 30_000
ROWS = [(5, "http://a/", "<p>" + "same " * 40), (3, "http://b/\r\nX: y", "<p>" + "same " * 40), (9, None, "<p>" + "same " * 40),
        (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", LONG), (8, "u", LONG), (7, "u", LONG),
        (None, "u", "no id " * 30), (None, "u", "<p>" + "same " * 40)]


def archive(spark, rows, **options):
    path = shared.new_path(spark, "warc-test")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, payload int")
    warc.write_archive(df, path, **options)
    return path


@pytest.mark.parametrize("options", [{}, {"segment": 1000, "records_per_file": 7}, {"compression": "gzip", "segment": 500}])
def test_round_trip(spark, options):
    read = warc.reassembled(warc.read_records(spark, archive(spark, ROWS, **options)))
    got = sorted(map(tuple, warc.summary(read).collect()), key=str)
    want = []
    for page, _, html in ROWS:
        payload = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(payload) >= 100 and page is not None else page
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if first != page else "response",
                     first if first != page else None))
    assert got == sorted(want, key=str)


def test_lost_segment_and_wrong_total(spark):
    found = warc.read_records(spark, archive(spark, [(1, "u", LONG)], segment=4000)).cache()
    assert found.count() > 20
    assert not warc.reassembled(found.filter("segment_number IS NULL OR segment_number <> 5")).first().intact
    last = found.agg({"segment_number": "max"}).first()[0]
    assert not warc.reassembled(found.filter(f"segment_number <> {last}")).first().intact
    assert warc.reassembled(found).first().intact
    with pytest.raises(Exception, match="damaged record"):
        warc.summary(warc.reassembled(found.filter(f"segment_number <> {last}"))).collect()
    found.unpersist()


def test_damage_is_an_error():
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse(whole * 3))) == 3
    for bad in (whole.replace(b"Content-Length: 3\r\n", b""), whole.replace(b": 3", b": 9999"), b"WARC/1.1\r\nWARC-Type: resource"):
        with pytest.raises(ValueError, match="damaged record"):
            list(warc.parse(whole + bad))


def test_chunks():
    for n in (0, 1, 8191, 8192, 8193, 100_000):
        data = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.unchunked(b"4\r\nabc\r\n0\r\n\r\n") is None and warc.unchunked(b"") is None and warc.unchunked(b"zz\r\n") is None


def test_empty(spark):
    read = warc.reassembled(warc.read_records(spark, archive(spark, [])))
    assert warc.summary(read).collect() == []
