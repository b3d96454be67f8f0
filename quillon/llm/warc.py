"""WARC archives: written as files, read back, and assembled into one nested row for each capture.

Writing.  A page gives three records: a request, a response (or a revisit, if its payload is stored with another
page), and a metadata record; request and metadata name the response in WARC-Concurrent-To.  Of pages with equal
payloads of REVISIT_BYTES or more, the one with the largest page_id is the response; pages that tie for it are all
responses.  Executors write gzip files to the shared folder; a file's size is bounded by the largest page in it.

Reading.  Each file is read by one task as a stream, record by record by Content-Length, so that payloads may hold
anything, WARC headers too.  Response payloads are hashed again and must agree with their header.

Assembly.  Records of one transaction meet by the concurrent-to identifier, which is unique to a page row: no key has
more than three records.

Nulls: a null html is an empty payload, a null url or page_id leaves its header out.  Repeated rows are captures of
their own.  Pages whose page_id is null never are the response that others revisit unless all of their group are null;
then all are responses.  Other columns aren't archived.  A page of any size is one payload, read whole.  Without
pages there are no archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import read_table, scratch_path, ship

REVISIT_BYTES = 1000
#: Parts into which the pages of one payload are dealt for the join with their group.
SALTS = 32
#: Bytes of an archive file before compression, unless a single page has more; larger pages have archives of their own.
FILE_BYTES, LARGE_BYTES = 32 << 20, 1 << 20
CRLF = "\r\n"


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, n (payload bytes), digest, target (page_id of the response if this is a revisit), and whether
    this page is the one response that others name."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html).alias("digest"))
    copies = own.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n", "page_id").agg(F.count("*").alias("k"))
    groups = copies.groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.max_by("k", "page_id").alias("ties"), F.sum("k").alias("k")).where("k > 1")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "n", "salt"], "left")
    same = F.col("page_id") == F.col("last")
    return joined.select(
        "page_id", "url", "html", "n", "digest",
        F.when(F.col("last").isNotNull() & ~F.coalesce(same, F.lit(False)), F.col("last")).alias("target"),
        F.coalesce(same & (F.col("ties") == 1), F.lit(False)).alias("named"),
    )


def urn(*parts: Column) -> Column:
    """A record id from a hash, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def record(kind: Column, fields: list[Column], block: Column) -> Column:
    """A whole record without the two line ends behind it, which the writer adds."""
    size = F.octet_length(block)
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), header("WARC-Type", kind), *fields, header("Content-Length", size), F.lit(CRLF), block)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Write pages (page_id, url, html) as archives under path; returns the folders.  date: of all records."""
    marked = revisits(pages).withColumn("row", F.monotonically_increasing_id().cast("string"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    this = F.when(F.col("named"), urn(F.lit("named"), page, F.col("digest"))).otherwise(urn(F.lit("row"), F.col("row"), page, F.col("digest")))
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    marked = marked.select("*", this.alias("id"), uri.alias("uri"))
    when = header("WARC-Date", F.lit(date))
    common = [when, header("WARC-Target-URI", F.col("uri")), header("Page-ID", F.col("page_id"))]
    pay = [header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), header("Payload-Length", F.col("n"))]
    again = F.col("target").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    refers = [
        header("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("WARC-Refers-To", F.when(again, urn(F.lit("named"), F.col("target").cast("string"), F.col("digest")))),
        header("Refers-To-Page-ID", F.col("target")),
    ]
    about = lambda name: [header("WARC-Record-ID", urn(F.lit(name), F.col("id"))), header("WARC-Concurrent-To", F.col("id"))]
    response = record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), [header("WARC-Record-ID", F.col("id")), *common, *pay, *refers, header("Content-Type", F.lit("application/http; msgtype=response"))], F.when(again, http).otherwise(F.concat(http, F.col("html"))))
    request = record(F.lit("request"), [*about("request"), *common, header("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    metadata = record(F.lit("metadata"), [*about("metadata"), *common, header("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit(CRLF)))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    most = {bool(r["large"]): r["most"] for r in pages.groupBy((size > LARGE_BYTES).alias("large")).agg(F.max(size).alias("most")).collect()}
    out = []
    for large, top in most.items():
        rows = marked.where(F.col("n") > LARGE_BYTES if large else F.col("n") <= LARGE_BYTES)
        lines = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
        out.append(f"{path}/{'large' if large else 'pages'}")
        per_file = 3 * max(1, FILE_BYTES // (top + 4096))
        lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(out[-1])
    return out


class Unpacked:
    """A gzip file's bytes as a stream."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer, self.engine = memoryview(raw), 0, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= len(self.raw) and not self.engine.unconsumed_tail:
            return False
        part = self.engine.unconsumed_tail or self.raw[self.at : self.at + (1 << 16)]
        if not self.engine.unconsumed_tail:
            self.at += len(part)
        self.buffer += self.engine.decompress(part, 1 << 20)
        if self.engine.eof and self.engine.unused_data:  # the next member
            rest, self.engine = self.engine.unused_data, zlib.decompressobj(31)
            self.buffer += self.engine.decompress(rest, 1 << 20)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                return None
        out = bytes(self.buffer[:k])
        del self.buffer[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip file."""
    stream = Unpacked(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        yield fields, stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")


RECORD = {"kind": "string", "record_id": "string", "concurrent_to": "string", "refers_to_record": "string", "page_id": "bigint", "refers_to": "bigint", "uri": "string", "payload_bytes": "bigint", "payload_digest": "string", "payload": "binary"}


def read(spark: SparkSession, folders: list[str], with_payload: bool = True) -> DataFrame:
    """The records of archives; payload only if asked for, and null for records that carry none."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pour() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(RECORD)
            kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, RECORD.values(), strict=True)], names=list(RECORD))

        for batch in batches:
            for i in range(batch.num_rows):
                out, held = [], 0
                for fields, block in parse(batch.column(0)[i].as_py()):
                    kind, number = fields["warc-type"], lambda name, f=fields: int(f[name]) if name in f else None
                    digest, size, payload = fields.get("warc-payload-digest", "")[5:] or None, number("payload-length"), None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if (digest, size) != (found := (hashlib.sha1(payload).hexdigest(), len(payload))):
                            raise ValueError(f"{fields['warc-record-id']}: payload {found}, header {(digest, size)}")
                    held += len(block) if with_payload else 0
                    names = ("warc-concurrent-to", "warc-refers-to")
                    out.append((kind, fields["warc-record-id"], *map(fields.get, names), number("page-id"), number("refers-to-page-id"), fields.get("warc-target-uri"), size, digest, payload if with_payload else None))
                    if len(out) >= 4096 or held > 4 << 20:
                        yield pour()
                        out, held = [], 0
                yield pour()

    return files.select("content").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in RECORD.items()))


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, and the structs request, response (or revisit) and metadata."""
    fields = F.struct(*RECORD)
    of = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), fields), ignorenulls=True)
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    return records.groupBy(key).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folders = write(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc"))
    captures = assemble(read(spark, folders, with_payload=False)) if folders else assemble(spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in RECORD.items())))
    r = "response."
    return captures.select(r + "page_id", r + "payload_bytes", r + "payload_digest", F.col(r + "kind").alias("record_type"), r + "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""
