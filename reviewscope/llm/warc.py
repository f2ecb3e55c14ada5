"""WARC archives: writing captures, reading records back, and assembling the transactions.

Each capture is three records: the response (or a revisit, if its payload is archived already), the request and
metadata; the last two name the first as the one they are concurrent to. `write` lets Spark's text sink write them
gzipped, with the blank lines that end a record as its line separator, and `records` reads the files as bytes
and cuts them by their Content-Length, so a payload may hold anything. `transactions` joins the three again and emits one nested row
per capture.

Of captures with one payload of at least `LEAST` bytes, the one with the smallest page id is the response. All ids are
digests of page id, url and payload, so a task that runs again writes the same records.

Edge cases: a null payload is empty; a null url is left out of the records; a null page id comes back as null, and is
a response only if no capture of the payload has an id. Rows that repeat page id, url and payload are archived as often as given, under the
same ids, and come back as often. A file holds the captures of one of the classes in `FILES`, so about 128 MiB at most or a single larger
one; it is unpacked as a stream. A request or metadata record without its response still makes a row,
with a null response. An empty table gives empty archives. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewscope.session import scratch_path, stored

LEAST = 100
#: (largest payload in bytes, captures in a file); payloads beyond the last have files of their own.
FILES = ((64 << 10, 2000), (4 << 20, 32))
COPIES = 4096
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"


# ------------------------------------------------------------------------------------ writing
def record_id(kind: str) -> Column:
    d = F.md5(F.concat_ws("\n", F.lit(kind), F.coalesce(F.col("page").cast("string"), F.lit("null")), "url", "digest").cast("binary"))
    parts = [F.substring(d, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(headers: dict[str, Column], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers.items()]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat_ws(END, F.lit("WARC/1.1"), *lines, size, F.lit(""), block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> None:
    rows = pages.select(
        F.col(f"`{key}`").alias("page"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"),
        _header_value(F.col(f"`{url}`")).alias("url"),
    )
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload"))
    # Written first: Spark then knows how small the table of repeated payloads is, and moves no page to meet it if it can.
    again = rows.filter(F.col("size") >= LEAST).groupBy("digest")
    again = again.agg(F.min(F.struct("page", "url")).alias("any"), F.min(F.when(F.col("page").isNotNull(), F.struct("page", "url"))).alias("least"), F.count(F.lit(1)).alias("n"))
    again = again.filter("n > 1").select("digest", F.coalesce("least", "any").alias("first"))
    again = stored(again.select("digest", "first", F.lit(True).alias("known")), "warc-payloads")
    rows = rows.join(again, "digest", "left")
    same = F.col("first.page").eqNullSafe(F.col("page"))
    rows = rows.withColumn("revisit", F.coalesce(F.col("known") & F.col("first.page").isNotNull() & ~same, F.lit(False)))
    rows = rows.withColumn("id", record_id("capture"))
    # The response's id, from the same parts as its own record's.
    first = rows.select("*", F.struct("page", "url").alias("own")).withColumn("page", F.col("first.page")).withColumn("url", F.col("first.url"))
    rows = first.withColumn("refers", F.when(F.col("revisit"), record_id("capture"))).withColumn("page", F.col("own.page")).withColumn("url", F.col("own.url"))

    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("url")}
    http = F.concat_ws(
        END, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), F.lit(""), F.lit("")
    )
    response = record(
        {
            "WARC-Type": kind,
            "WARC-Record-ID": F.col("id"),
            **common,
            "WARC-Refers-To": F.col("refers"),
            "WARC-Profile": F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
            "Content-Type": F.lit("application/http;msgtype=response"),
        },
        F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))),
    )
    request = record(
        {
            "WARC-Type": F.lit("request"),
            "WARC-Record-ID": record_id("request"),
            **common,
            "WARC-Concurrent-To": F.col("id"),
            "Content-Type": F.lit("application/http;msgtype=request"),
        },
        F.concat_ws(END, F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1")), F.lit(""), F.lit("")),
    )
    metadata = record(
        {
            "WARC-Type": F.lit("metadata"),
            "WARC-Record-ID": record_id("metadata"),
            **common,
            "WARC-Concurrent-To": F.col("id"),
            "Content-Type": F.lit("application/warc-fields"),
        },
        F.concat_ws(END, F.concat(F.lit("page-id: "), F.col("page").cast("string")), F.lit("via: pages"), F.lit("")),
    )
    out = rows.select("size", F.concat_ws(END * 2, response, request, metadata).alias("value"))
    largest = rows.agg(F.max("size")).first()[0] or 0
    least = -1
    for most, captures_in in (*FILES, (1 << 40, 1)):
        if largest > least:
            own = out.filter((F.col("size") > least) & (F.col("size") <= most)).select("value")
            own.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", captures_in).text(f"{path}/upto-{most}")
        least = most


def _header_value(value: Column) -> Column:
    """A url without the characters that would end the header or its value."""
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


# ------------------------------------------------------------------------------------ reading
FIELDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, declared string, "
    "payload binary, payload_bytes long, payload_sha256 string, block string"
)


def cut(stream) -> dict:
    """The records of an unpacked archive, one after the other."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one has to begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield headers | {"block": block}


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in a folder; payloads are checked against their length and digest, and kept if asked for."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in cut(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    kind, block, payload = r["warc-type"], r["block"], None
                    if kind in ("response", "revisit"):
                        _, _, payload = block.partition(b"\r\n\r\n")
                        block = block[: len(block) - len(payload)]
                    found = payload is not None and kind == "response"
                    digest = hashlib.sha256(payload).hexdigest() if found else None
                    declared = r.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if found and declared not in (None, digest):
                        raise ValueError(f"payload of {r['warc-record-id']} does not have its digest")
                    rows.append(
                        (
                            r["warc-record-id"], kind, r.get("warc-concurrent-to"), r.get("warc-refers-to"), r.get("warc-target-uri"), declared,
                            payload if found and with_payload else None, len(payload) if found else None, digest, block.decode("utf-8", "replace"),
                        )
                    )
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 6 + (pa.binary(), pa.int64(), pa.string(), pa.string())
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture (its id), response, request, metadata (structs of the records' columns) and times.

    `times` says how often the response was archived: rows that repeat have one id.

    Records meet at the id that they have or are concurrent to. If several say that they are a capture's request (or metadata), the one
    with the smallest id counts, so a capture is one row of bounded size.
    """
    rows = found.select(F.coalesce("concurrent_to", "record_id").alias("capture"), F.struct(*found.columns).alias("record"))

    def one(name: str, *kinds: str) -> Column:
        return F.min_by(F.when(F.col("record.type").isin(*kinds), F.col("record")), F.when(F.col("record.type").isin(*kinds), F.col("record.record_id"))).alias(name)

    times = F.count_if(F.col("record.type").isin("response", "revisit")).alias("times")
    return rows.groupBy("capture").agg(one("response", "response", "revisit"), one("request", "request"), one("metadata", "metadata"), times)


def repeated(rows: DataFrame, times: str = "times") -> DataFrame:
    """Each row as often as its `times` says; a large number is unfolded in two steps of bounded arrays."""
    last = F.col(times) - 1
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + COPIES - 1, last)))).drop("block", "copy", times)


def captures(found: DataFrame, key_type: str = "long") -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits are resolved to their response."""
    page = F.regexp_extract("metadata.block", r"(?m)^page-id: (.*?)\r?$", 1)
    rows = transactions(found).filter("response is not null").select(
        "capture",
        F.when(page != "", page).cast(key_type).alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers"),
        F.col("response.payload_bytes").alias("bytes"),
        F.coalesce("response.payload_sha256", "response.declared").alias("payload_digest"),
        "times",
    )
    rows = stored(rows, "warc-captures")
    responses = rows.filter("record_type = 'response'").select(F.col("capture").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("held"))
    return repeated(rows).join(responses, "refers", "left").select(
        "page_id", F.coalesce("bytes", "held").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive the pages below the shared folder, read the archives and report every capture."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    return captures(records(pages.sparkSession, path, with_payload=False), kind).withColumnRenamed("page_id", key)
