"""Secret scan against Python's own regular expressions."""

import hashlib
import re
import time

import pytest

from reviewscope.llm import credentials
from reviewscope.llm.queries import op1_scan_secrets

ASSIGN = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?i:passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


KEY = "AKIA" + "Q7" * 8
HEX = "0123456789abcdef" * 2
TEXTS = [
    None,
    "",
    "nothing here",
    f"é😀 {KEY} token = \"{HEX}\" x",
    "token=token:abcdefgh secret=abc password : 'hunter2!' API_KEY=abcdef apikey=\"abcde\"",
    f"{HEX[:23]} {HEX[:24]} AKIA1234 AKIAAKIA{'A' * 16} {HEX}{HEX}",
    "login: bob99 and nothing else",
    f"login: bob99 then {HEX}",
    "opaque " + "aB3" * 9 + " alone",
    "client_id=app.web and opaque " + "aB3" * 9,
    "https://db.example.com/x and secret=abcdef99 " + "pad " * 100 + "https://far.example.com",
    "host: db1.example.com user=joe " + "z" * 300 + " token=abcdef1",
    f"token={HEX} " * 400,
    "a b\x00\x01 token=abcdefg\n\ttoken\x20\x20=\x20\x20abcdefg token\t=abcdefg",
]


def test_base_and_links(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], 1), (3, TEXTS[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = credentials.scan(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        want = base(t or "")
        r = by[i]
        assert r["base"] == listed(want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _, _ in want) for j in range(3))
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    kinds = lambda i: [s.split(":")[0] for s in by[i]["spans"].split(",") if s]
    assert kinds(6) == [] and kinds(8) == [] and kinds(2) == []
    assert kinds(7) == ["login", "hex"] and kinds(9) == ["login", "opaque"]
    assert kinds(10) == ["endpoint", "assign"]  # the far endpoint is out of reach
    assert kinds(11) == ["assign"]
    assert sum(r["spans"] == by[3]["spans"] for r in got) == 3


def test_query_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_scan_secrets(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(listed(base(docs[r["doc_id"]] or "")).encode()).hexdigest()
    assert credentials.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["host=" + "a." * 500_000 + "a", "token=abcdef " * 77_000, "pass" * 250_000, "a." * 500_000, "token" + " " * 1_000_000, "user=abc9 " * 100_000])
def test_a_megabyte_of_one_thing(spark, text):
    began = time.perf_counter()
    (row,) = credentials.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["base"] == listed(base(text))
    assert time.perf_counter() - began < 25  # alone about 3
