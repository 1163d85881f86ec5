import hashlib

import pytest

from unionlog.llm import arc_to_warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to string")


def run(spark, df):
    return W.read_archives(W.write_archives(df, W.shared_dir(spark)))


def test_versions_and_declared_lengths():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nline\nhttp://fake 0.0.0.0 1 text/html 5\nxxxxx"
    for version in (1, 2):
        data = W.arc_version_block(version, "a.arc") + W.arc_record(version, "http://a b", "text/html", body) + W.arc_record(version, "dns:x", "text/dns", b"")
        (h1, b1), (h2, b2) = W.parse_arc(data)
        assert (h1["URL"], b1, h2["Content-type"], b2) == ("http://a%20b", body, "text/dns", b"")
        assert set(h1) == set(W.ARC_FIELDS[version])
    for bad in (data[:-5], b"http://x 0.0.0.0 20240101000000 text/html 0\n\n", data.replace(b"2 0 unionlog", b"9 0 unionlog")):
        with pytest.raises(W.ArcError):
            list(W.parse_arc(bad))
    assert W.iso_date("20240102030405") == "2024-01-02T03:04:05Z"
    first = W.to_warc(h1, b1)
    assert first == W.to_warc(h1, b1) and b"WARC-Type: response" in first and b"WARC-Type: resource" in W.to_warc(h2, b2)


def test_round_trip_by_brute_force(spark):
    big = "é" * 60
    rows = [(5, "u5", big, "", ""), (3, "u3", big, "", ""), (9, None, big, "", ""), (1, "u1", "short", "", ""), (2, "u2", "short", "", ""), (4, "u 4\n", None, None, None), (6, "u", "x" * 99, "", ""), (7, "u", "x" * 99, "", ""), (None, "n", big, "", ""), (3, "u3", big, "", "")]
    got = sorted((tuple(r) for r in run(spark, pages(spark, rows)).collect()), key=str)
    want = []
    for page, _, html, *_ in rows:
        b = (html or "").encode()
        firsts = [p for p, _, h, *_ in rows if p is not None and (h or "").encode() == b and len(b) >= 100]
        ref = min(firsts) if firsts and page != min(firsts) else None
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert run(spark, pages(spark, [])).count() == 0
