"""WARC archives with boundary-chain verification (operator 5).

Writing: every page is a record of the Spark text sink, whose line ends close
the records, in files of at most ``records_per_file`` records.  Of pages with
equal payloads the largest id is a response, the others revisit it.

Reading: tasks scan whole files for record magic and emit, for everything that
parses as a header, the offset, the successor's offset and the record's
fields.  Magic inside a payload gives candidates, too; pointer jumping from
the start of each file (reached sets and jumps double every round, so
``log2(records per file)`` rounds) keeps the records on the chain only.

Defined cases: null html is an empty payload; null urls are empty; rows with
the largest id of their payload are all responses, also when repeated; a null
id is never the largest, and revisits only where a non-null id has its
payload; an empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.components import cut
from shelfwise.session import checkpoint_dir

MAGIC = b"WARC/1.0\r\n"
_HEADER = re.compile(rb"WARC/1\.0\r\n((?:[^\r\n]+\r\n)+)\r\n")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIELDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of five,
    each of them four base32 digits."""
    hexed = F.sha1(payload)

    def four(i: int) -> list[Column]:
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
                for s in (15, 10, 5, 0)]

    return F.concat(*[c for i in range(8) for c in four(i)])


def records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """The pages as WARC records: one column ``record`` without the last line
    feed, which the text sink adds."""
    p = pages.select(F.col(id_col).cast("long").alias("id"),
                     F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload")))
    largest = (p.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
               .agg(F.max("id").alias("to")))
    p = p.join(largest, "digest", "left")
    revisit = F.col("to").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return p.select(F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", urn("to"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n\r")).alias("record"))


def write(pages: DataFrame, folder: str, records_per_file: int = 256, **kw) -> None:
    (records(pages, **kw).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file)
     .text(folder))


def _candidates(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Everything in a file that reads like a record: offset, successor,
    header fields, payload."""
    at = data.find(MAGIC)
    while at >= 0:
        m = _HEADER.match(data, at)
        if m:
            head = dict(x.split(b":", 1) for x in m[1].split(b"\r\n") if b":" in x)
            head = {k.strip().lower(): v.strip() for k, v in head.items()}
            n = head.get(b"content-length", b"")
            if n.isdigit() and data[m.end() + int(n):m.end() + int(n) + 4] == b"\r\n\r\n":
                yield at, m.end() + int(n) + 4, head, data[m.end():m.end() + int(n)]
        at = data.find(MAGIC, at + 1)


def _page(head: dict[bytes, bytes], field: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(field, b""))
    return int(m[1]) if m else None


def candidates(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """``(file, at, next)`` and the record's fields for everything that parses
    as a record."""
    schema = f"file string, at long, next long, {FIELDS}" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                for at, nxt, head, payload in _candidates(content.as_py()):
                    row = (path.as_py(), at, nxt, _page(head, b"warc-record-id"),
                           head.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
                           head.get(b"warc-type", b"").decode("ascii", "replace"),
                           _page(head, b"warc-refers-to"), len(payload),
                           base64.b32encode(hashlib.sha1(payload).digest()).decode()
                           if head.get(b"warc-type") == b"response" else
                           head.get(b"warc-payload-digest", b"").decode("ascii", "replace")
                           .removeprefix("sha1:"))
                    out.append(row + (payload,) * with_payload)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
             .select("path", "content"))
    return files.mapInArrow(run, schema)


def reachable(links: DataFrame) -> DataFrame:
    """``(file, at)`` of the records on the chain from the start of each file,
    by pointer jumping over ``(file, at, next)``."""
    jump = cut(links.select("file", "at", "next"))
    reached = jump.filter("at = 0").select("file", "at")
    while True:
        step = (reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
                .join(links.select("file", "at"), ["file", "at"]))
        reached = cut(reached.union(step).distinct())
        to = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = cut(jump.join(to, ["file", "next"]).select("file", "at", F.col("after").alias("next")))
        if jump.isEmpty():
            return reached


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a folder."""
    found = cut(candidates(spark, folder, with_payload))
    return found.join(reachable(found), ["file", "at"]).drop("file", "at", "next")


def round_trip(pages: DataFrame, min_bytes: int = 0, records_per_file: int = 256, **kw) -> DataFrame:
    """Write the pages, read the archives back and resolve the revisits: one
    row per page with the size and digest of its full payload."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, records_per_file, min_bytes=min_bytes, **kw)
    found = read(spark, folder)
    full = (found.filter("record_type = 'response'").groupBy("payload_digest")
            .agg(F.max("payload_bytes").alias("full_bytes")))
    return found.join(full, "payload_digest", "left").select(
        "page_id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to")
