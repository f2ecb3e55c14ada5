"""WARC round trip: odd payloads, revisits, transactions, damage."""

import gzip
import hashlib
import io

import pytest

from reviewscope.llm import warc
from reviewscope.session import scratch_path

LONG = "é" * 60
PAGES = [
    (1, "http://a.example/1", "short"),
    (2, "http://a.example/2", "short"),
    (5, "http://a.example/x y\r\nWARC-Type: request", LONG),
    (3, "http://a.example/3", LONG),
    (9, None, LONG),
    (None, "http://a.example/n", LONG),
    (6, "http://a.example/6", None),
    (7, "http://a.example/7", ""),
    (8, "", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9 + "\x00\x1a"),
    (10, "http://a.example/10", "x" * 300_000),
    (4, "http://a.example/4", "y" * 100),
    (4, "http://a.example/4", "y" * 100),
    (11, "http://a.example/11", "z" * 99),
    (12, "http://a.example/12", "z" * 99),
    (None, "http://a.example/m", "m" * 200),
    (None, "http://a.example/o", "m" * 200),
]


def expected(pages):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, url, html in pages:
        data, least = (html or "").encode(), first.get(html or "")
        again = len(data) >= 100 and least is not None and least != page
        out.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(((p, *rest) for p, _, *rest in out), key=repr)


def test_many_copies_of_a_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [(3, "http://a.example/3", LONG)] * 50 + [(9, "http://a.example/9", LONG)] * 15 + [(1, None, "p" * 5_000_000)] + [(2, "u", None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == expected(rows)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(PAGES)], "page_id long, url string, html string, digest int").repartition(3)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == expected(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_transactions_are_nested_and_whole(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = scratch_path(spark, "warc-test")
    warc.write(df, path)
    found = warc.records(spark, path)
    rows = warc.transactions(found).collect()
    assert len(rows) == 15  # two rows of PAGES are one capture
    for r in rows:
        assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["response"]["record_id"] == r["capture"]
        assert r["request"]["block"].startswith("GET ")
    payloads = sorted(bytes(r["response"]["payload"]) for r in rows if r["response"]["type"] == "response")
    responses = {(p, u, h) for (p, u, h) in PAGES if (p, h) not in ((5, LONG), (9, LONG), (None, LONG))}
    assert payloads == sorted((h or "").encode() for _, _, h in responses)
    lonely = found.filter("type <> 'response'")
    assert warc.transactions(lonely).filter("response is null").count() == len(responses)


def test_damage_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r["block"] for r in warc.cut(io.BytesIO(good * 2))] == [b"hello"] * 2
    for bad in (good[:-8], b"junk" + good):
        with pytest.raises(ValueError):
            list(warc.cut(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(bad)))))
