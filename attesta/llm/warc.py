"""WARC archives: write captures, read records back, and assemble transactions.

A capture is a request, a response (or revisit) and a metadata record tied by
``WARC-Concurrent-To``. Records are built by SQL expressions and written by
Spark's text writer, so its commit protocol covers lost executors: a capture is
one output row and the line separator is the blank line that ends a WARC
record. Files are ``.gz`` and hold at most about 64 MB of pages, or one page
that is larger. The reader
walks ``Content-Length``, never separators, and takes plain files, whole-file
gzip and gzip members per record alike.

Defined results. Null html: an empty payload. Null url: no target URI. Null
page_id: a capture without a number. Rows that repeat in all three columns are
captures of their own, told apart by a number in their record ids; if their
payload is long enough, one of them is the response and the others revisit it.
Several records of a kind in one capture: the greatest is taken. Empty table:
no records. Extra columns are ignored. Line breaks
in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.bloom import membership
from attesta.llm.common import Scratch, join_counted

REVISIT_LEAST_BYTES = 1000
#: Pages of up to so many bytes, and how many captures of such pages a file holds.
FILE_CLASSES = ((1 << 14, 4096), (1 << 18, 256), (1 << 22, 16), (1 << 31, 1))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, fields map<string,string>"
)


def _key(page_id: Column, url: Column, digest: Column) -> Column:
    return F.concat_ws("\x1f", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("\x1e")), digest)


def _urn(kind: str, key: Column, nth: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), key, nth.cast("string")))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, size), F.lit(CRLF * 2), block)


def write_captures(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_LEAST_BYTES) -> None:
    """Write one capture per row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least`` bytes, that with the
    largest page_id is the response and the others are revisits of it.
    """
    scratch = Scratch(pages.sparkSession, "warc-owners")
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html"))
    own = own.withColumn("key", F.md5(_key(F.col("page_id"), F.col("url"), F.col("digest"))))
    light = scratch.keep(own.groupBy("key", "page_id", "url", "digest", "bytes").agg(F.count("*").alias("times")), "light")
    owners = (  # one row per payload that occurs again
        light.where(F.col("bytes") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("owner"), F.sum("times").alias("n")).where("n > 1")
    )
    owners = scratch.keep(owners, "owners")
    rows = _numbered(own, scratch.keep(light.where("times > 1").select("key", "times"), "repeats"))
    # Pages whose payload doesn't occur again are told by a Bloom filter and stay where they are.
    inside = membership(owners.select("digest"))
    maybe = (F.col("bytes") >= least) & (F.lit(True) if inside is None else inside("digest"))
    total = light.agg(F.sum("times")).first()[0] or 0
    rows = join_counted(rows.where(maybe), owners, ["digest"], "n", total, "left").drop("n").unionByName(rows.where(~maybe).withColumn("owner", F.lit(None).cast(owners.schema["owner"].dataType)))
    revisits = F.col("owner").isNotNull() & ((F.col("key") != F.col("owner.key")) | (F.col("nth") > 0))
    rows = rows.withColumn("revisit", revisits)

    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page_id, digest, key, nth = F.col("page_id"), F.col("digest"), F.col("key"), F.col("nth")
    here = _urn("response", key, nth)
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    answer = _record(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", here),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(F.col("revisit"), _urn("response", F.col("owner.key"), F.lit(0)))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.col("bytes").cast("string"),
            F.lit(CRLF * 2),
            F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")),
        ),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", key, nth)), *common, ("WARC-Concurrent-To", here), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", key, nth)), *common, ("WARC-Concurrent-To", here), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), page_id.cast("string"), F.lit(CRLF)), F.lit("")), F.lit(f"crawl-tool: attesta{CRLF}")),
    )
    value = F.concat_ws(CRLF * 2, request, answer, metadata)
    sizes = light.agg(*[F.coalesce(F.sum(F.when(F.col("bytes") <= most, 1)), F.lit(0)).alias(str(most)) for most, _ in FILE_CLASSES]).first()
    floor, before, written = -1, 0, False
    for most, each in FILE_CLASSES:
        if sizes[str(most)] > before or (not written and most == FILE_CLASSES[-1][0]):
            own_class = rows.where((F.col("bytes") > floor) & (F.col("bytes") <= most)).select(value.alias("value"))
            own_class.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(folder)
            written = True
        floor, before = most, sizes[str(most)]
    scratch.close()


def _numbered(own: DataFrame, repeats: DataFrame) -> DataFrame:
    """``own`` with ``nth``: 0, and on where rows repeat (``repeats``: key, times). Repeats are combined where they lie and dealt out again."""
    if repeats.isEmpty():
        return own.withColumn("nth", F.lit(0).cast("long"))
    inside = membership(repeats.select("key"))
    maybe = F.lit(True) if inside is None else inside("key")
    columns = own.columns
    one = own.where(maybe).groupBy("key").agg(*[F.first(c).alias(c) for c in columns if c != "key"]).join(repeats, "key", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    lots = one.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1000).cast("long")))).repartition("key", "lot")
    last = F.least((F.col("lot") + 1) * 1000, F.col("times")) - 1
    again = lots.withColumn("nth", F.explode(F.sequence(F.col("lot") * 1000, last)))
    return own.where(~maybe).withColumn("nth", F.lit(0).cast("long")).unionByName(again.select(*columns, "nth"))


def inflate(content: bytes) -> bytes:
    """Plain bytes of a plain file, a gzip file, or one gzip member per record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        if not member.eof:
            raise ValueError("a gzip member ends early")
        content = member.unused_data
    return b"".join(parts)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = data.index(b"\r\n\r\n", at)
        headers: dict[str, str] = {}
        for line in data[at:head].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        end = head + 4 + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, data[head + 4 : end]
        at = end + 4


def parse(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD and the payload: what follows the HTTP head of a response, else the block."""
    kind, fields, payload = headers.get("warc-type"), {}, block
    if kind in ("response", "revisit", "request") and headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
    row = (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), len(payload), hashlib.sha1(payload).hexdigest(), fields)
    return row, payload


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of every archive in ``folder``; payload binary only where asked for."""
    schema = RECORD + (", payload binary" if with_payload else "")
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in records(inflate(content.as_py())):
                    row, payload = parse(headers, block)
                    rows.append((*row[:7], list(row[7].items()), *[payload] * with_payload))
                    held += len(payload)
                    if len(rows) >= 5000 or with_payload and held > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata.

    A response or revisit record is its capture. Another record belongs to the
    one that it names in WARC-Concurrent-To, or that names it, directly or over
    one record between them. Records that lead to no response make a capture
    under the identifier where they meet.
    """
    answers = F.col("record_type").isin("response", "revisit")
    links = (
        found.where(F.col("concurrent_to").isNotNull())
        .select(F.when(answers, F.col("concurrent_to")).otherwise(F.col("record_id")).alias("member"), F.when(answers, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("anchor"))
        .groupBy("member").agg(F.max("anchor").alias("anchor"))
    )
    over = links.select(F.col("member").alias("__anchor"), F.col("anchor").alias("__second"))
    light = [c for c in found.columns if c not in ("concurrent_to",)]
    # An answer is its own capture; only the others follow links.
    own = found.where(answers).withColumn("capture_id", F.col("record_id"))
    direct = found.where(~answers | F.col("record_type").isNull()).join(links.withColumnRenamed("member", "record_id").withColumnRenamed("anchor", "__anchor"), "record_id", "left")
    second = direct.where(F.col("__anchor").isNotNull()).join(over, "__anchor", "left").withColumn("capture_id", F.coalesce("__second", "__anchor"))
    alone = direct.where(F.col("__anchor").isNull()).withColumn("capture_id", F.col("record_id"))
    placed = own.select("capture_id", *light).unionByName(second.select("capture_id", *light)).unionByName(alone.select("capture_id", *light))
    record = F.struct(*[c for c in light if c != "fields"], F.to_json("fields").alias("fields"))

    def one(*kinds: str) -> Column:
        return F.max(F.when(F.col("record_type").isin(*kinds), record))

    return placed.groupBy("capture_id").agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def resolve_revisits(captures: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``original``: the response that a revisit refers to (null for others), with its metadata."""
    scratch = scratch or Scratch(captures.sparkSession, "warc-originals")
    revisits = F.coalesce((F.col("response.record_type") == "revisit") & F.col("response.refers_to").isNotNull(), F.lit(False))
    asking = captures.where(revisits).withColumn("__refers_to", F.col("response.refers_to"))
    asked = scratch.keep(asking.groupBy("__refers_to").agg(F.count("*").alias("__n")), "asked")
    originals = captures.where(F.col("response.record_type") == "response").select(F.col("response.record_id").alias("__refers_to"), F.struct("response", "metadata").alias("original"))
    known = originals.join(asked, "__refers_to")
    if "payload" in captures.schema["response"].dataType.names:  # too large to send along: Spark splits a hot key's rows
        found = asking.join(known.drop("__n"), "__refers_to", "left").drop("__refers_to")
    else:
        found = join_counted(asking, scratch.keep(known, "originals"), ["__refers_to"], "__n", asked.agg(F.sum("__n")).first()[0] or 0, "left").drop("__refers_to", "__n")
    return found.unionByName(captures.where(~revisits).withColumn("original", F.lit(None).cast(found.schema["original"].dataType)))


def page_of(metadata: str) -> Column:
    return F.get_json_object(F.col(f"{metadata}.fields"), "$['page-id']").cast("long")
