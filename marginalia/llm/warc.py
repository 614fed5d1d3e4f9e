"""WARC archives: write pages as records, normalise whole-file gzip streams, read records back by offset.

``write_streams`` writes archives as Spark's text writer compresses them: one gzip stream over each whole file, so no
record can be read without inflating all before it. ``normalise`` inflates such a stream once, rewrites every record as a
gzip member of its own and keeps a sidecar index (archive, offset, length). ``read_records`` reads single members by it.

Pages of equal payload are stored once: the page with the largest id is the response, the others are revisits that refer
to it. The largest id per digest is a map-side combined aggregate; a hot digest meets its pages in a join that adaptive
execution can split.

Files go to a folder all executors reach, through pyarrow's file systems. Each task writes its archive under a name of its
own and renames it when complete, so a task that runs twice leaves the same file.

Defined results: a null html is an empty payload; pages with a null id are told apart by nothing else and come back with a
null id (a revisit, if any equal payload has an id); rows that repeat the largest id are all responses; a null url leaves
its header out; an empty table gives an empty folder and no rows; archives cut off inside a record raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION, END, BASE32 = "WARC/1.1", "\r\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
PAGE_URN = "urn:x-page:"
_CHUNK = 1 << 20

INDEX = ("archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's bytes: 40 bits of the hexadecimal form give eight digits to base 32."""
    digest = F.sha1(payload.cast("binary"))
    digits = [F.lpad(F.conv(F.substr(digest, F.lit(at), F.lit(10)), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html)."""
    told = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    told = told.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    told = told.withColumn("payload_digest", base32_sha1(F.col("payload")))
    first = told.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes") \
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    told = told.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull(), F.lit(False))
    return told.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                       F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("largest")).alias("refers_to"))


def record_text(pages: DataFrame) -> DataFrame:
    """One WARC record per decided page as a text, without the line end that closes it."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat_ws(
        END, F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit(f"WARC-Record-ID: <{PAGE_URN}"), number("page_id"), F.lit(">")),
        F.lit(f"WARC-Date: {CAPTURED}"), F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), number("payload_bytes")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{PAGE_URN}"), number("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(number("payload_bytes"))))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return pages.select(F.concat(head, F.lit(END + END), body, F.lit(END)).alias("value"))


def write_streams(pages: DataFrame, path: str) -> None:
    """Writes decided pages as archives of one gzip stream per file."""
    record_text(pages).write.option("compression", "gzip").option("lineSep", END).text(path)


class _Stream:
    """Bytes of a gzip file, inflated piece by piece; several members in a row are one stream."""

    def __init__(self, packed: memoryview) -> None:
        self.packed, self.spot, self.buffer = packed, 0, bytearray()
        self.inflate, self.open = zlib.decompressobj(31), False

    def _more(self) -> bool:
        rest = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate, self.open = zlib.decompressobj(31), False
        piece = rest or bytes(self.packed[self.spot:self.spot + _CHUNK])
        if not rest:
            self.spot += len(piece)
        if not piece:
            if self.open:
                raise ValueError("the archive ends inside a gzip stream")
            return False
        self.open = True
        self.buffer += self.inflate.decompress(piece)
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes | None:
        """Up to and including the blank line after a record's header; None at the end of the archive."""
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        return self.take(end + 4)


def parse_head(head: bytes) -> dict[str, str]:
    first, *rest = head.decode("utf-8", "surrogateescape").rstrip("\r\n").split(END)
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:80]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in rest)}


def records(packed: bytes | memoryview) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Header bytes, header fields and content of each record of one archive."""
    stream = _Stream(memoryview(packed))
    while (head := stream.head()) is not None:
        fields = parse_head(head)
        content = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        yield head, fields, content


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _page(fields: dict[str, str], name: str) -> int | None:
    number = fields.get(name, "").strip("<>").removeprefix(PAGE_URN)
    return int(number) if number else None


def _told(fields: dict[str, str], content: bytes) -> tuple:
    """What a record says; a response's length and digest are measured, a revisit's are those it states."""
    kind = fields["warc-type"]
    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size, measured = len(content), base64.b32encode(hashlib.sha1(content).digest()).decode()
        if measured != digest:
            raise ValueError(f"the digest of {fields['warc-record-id']} differs")
    return _page(fields, "warc-record-id"), kind, _page(fields, "warc-refers-to"), size, digest


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def normalise(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Rewrites the archives below ``path`` into ``out`` with one gzip member per record.

    Gives the sidecar index, one row per record in the order of each archive, which the caller writes.
    """
    schema = INDEX
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(out)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for source, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = hashlib.md5(source.encode()).hexdigest() + ".warc.gz"
                rows, offset = [], 0
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as sink:
                    for head, fields, body in records(memoryview(content.as_buffer())):
                        packed = member(head + body + b"\r\n\r\n")
                        sink.write(packed)
                        page, kind, refers, size, digest = _told(fields, body)
                        rows.append((name, offset, len(packed), page, kind, refers, size, digest))
                        offset += len(packed)
                system.move(part, f"{folder}/{name}")
                for at in range(0, len(rows), 5000):
                    columns = zip(*rows[at:at + 5000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if n in ("archive", "record_type", "payload_digest") else pa.int64())
                         for c, n in zip(columns, names)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def read_records(index: DataFrame, out: str) -> DataFrame:
    """Reads the records that ``index`` lists, each by its own offset, and tells what the archives say of them."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(out)
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, system.open_input_file(f"{folder}/{archive}")
                (_, fields, content), = records(source.read_at(length, offset))
                page, kind, refers, size, digest = _told(fields, content)
                rows.append((page, size, digest, kind, refers))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("payload_digest", "record_type") else pa.int64())
                                              for c, n in zip(columns, names)], names=names)
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages as whole-file streams, normalises them and reads the archives back; all files stay below ``folder``."""
    spark = pages.sparkSession
    write_streams(decide(pages, least_bytes), f"{folder}/streams")
    index = normalise(spark, f"{folder}/streams", f"{folder}/archives")
    index.write.parquet(f"{folder}/index")
    return read_records(spark.read.schema(INDEX).parquet(f"{folder}/index"), f"{folder}/archives")
