"""WARC archives: a writer in DataFrame terms and a Python data source to read.

Writing. A record is one string, ``header block CRLF payload``, and the two
CRLF that end a record are the line separator of Spark's text writer. So the
archives are plain uncompressed WARC/1.1 files, written by Spark to any file
system, in files of at most ``records_per_file`` records.

Equal payloads (SHA-256 and length) of at least ``min_bytes`` are stored once:
the record with the largest page id is the response, the others are revisit
records without payload that name it. The largest id per payload is a combined
aggregate, joined back on the digest; a hot payload is split by the skew join.
A fixed-size sketch of the repeated digests keeps all other payloads out of the
shuffle.

Reading. ``WarcSource`` (format ``warc``) plans one partition per group of whole
files (an uncompressed WARC can't be entered safely in its middle, since a
payload may contain what looks like a record). Equality and ``IN`` filters on
``record_type`` and on header columns are pushed down (session setting
``spark.sql.python.filterPushdown.enabled``). The header is parsed first. The
payload of a record that a pushed filter rejects, or that the options do not
ask for (``payload=false``), is skipped by its Content-Length and never decoded.

Defined results: a null or empty html is an empty payload. A null page id is
written without its header and read back as null; it never is the response if
the group has an id. Rows repeating both id and payload are all responses.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quarry.llm.common import fresh_path
from quarry.plans.sketch import flagged, key_sketch

RECORD_END = "\r\n\r\n"
PAGE_HEADER = "Quarry-Page-Id"
REFERS_HEADER = "Quarry-Refers-To-Page-Id"
LENGTH_HEADER = "Quarry-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
          "refers_to long, payload binary")
#: column -> header, for the columns whose filters can be decided on headers
HEADER_OF = {"record_type": "warc-type", "url": "warc-target-uri", "payload_digest": "warc-payload-digest",
             "page_id": PAGE_HEADER.lower(), "refers_to": REFERS_HEADER.lower(), "payload_bytes": LENGTH_HEADER.lower()}


def base32_sha1(binary):
    """Upper-case base32 of the SHA-1, without padding (160 bits are 32 digits)."""
    hexes = F.sha1(binary)
    parts = [F.lpad(F.upper(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def planned_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (string), payload_bytes, payload_digest, record_type, refers_to."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumns({"_key": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.octet_length("payload").cast("long")})
    # only ids and digests are aggregated; the key holds the length too
    first = (p.groupBy("_key", "payload_bytes").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
             .where((F.col("_n") > 1) & (F.col("payload_bytes") >= min_bytes)).drop("_n"))
    # payloads that surely occur once are written where they are read, not moved
    marked = flagged(p, key_sketch(first, "_key"), "_key", "_many")
    alone = marked.where(~F.col("_many")).withColumn("_response", F.lit(None).cast(pages.schema["page_id"].dataType))
    out = (marked.where("_many").join(first, ["_key", "payload_bytes"], "left").unionByName(alone))
    revisit = F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return out.select("page_id", "url", "payload", "payload_bytes", base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"),
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("_response")).alias("refers_to"))


def escaped_uri(col):
    """A header value must stay on its line: control characters and % are percent-escaped."""
    out = F.replace(col, F.lit("%"), F.lit("%25"))
    for c in [*map(chr, range(33)), "\x7f"]:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def record_text(date: str = "2024-01-01T00:00:00Z"):
    """A whole record but for its end, from the columns of ``planned_records``."""
    def header(name, value):  # left out where the value is null
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))

    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(F.lit(7)), F.lit(">"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        header("WARC-Target-URI", escaped_uri(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        header(PAGE_HEADER, F.col("page_id")),
        header(REFERS_HEADER, F.col("refers_to")),
        header(LENGTH_HEADER, F.col("payload_bytes")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        header("Content-Length", F.octet_length(body)),
        F.lit("\r\n"), body)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 50_000) -> None:
    (planned_records(pages, min_bytes).select(record_text().alias("value")).write
     .option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path))


class FileGroup(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def filesystem(path: str):
    """(pyarrow file system, path in it) of a local path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_header(stream) -> dict[str, str] | None:
    """The next record's header (names in lower case); None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def columns_of(header: dict[str, str]) -> dict:
    """The columns that the header decides."""
    number = lambda name: int(header[name]) if name in header else None
    digest = header.get("warc-payload-digest")
    url = header.get("warc-target-uri")
    return {"page_id": number(PAGE_HEADER.lower()), "url": None if url is None else unquote(url),
            "record_type": header.get("warc-type"), "payload_digest": digest and digest.removeprefix("sha1:"),
            "payload_bytes": number(LENGTH_HEADER.lower()), "refers_to": number(REFERS_HEADER.lower())}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.group_bytes = int(options.get("groupBytes", 64 << 20))
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values
            else:
                yield f  # Spark applies it afterwards

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs

        where, root = filesystem(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True)) if where.get_file_info(root).type == fs.FileType.Directory else [where.get_file_info(root)]
        files = sorted((x for x in found if x.is_file and x.size and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        groups, size = [], 0
        for x in files:
            if not groups or size + x.size > self.group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [FileGroup(g) for g in groups] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        where, _ = filesystem(self.path)
        for name in partition.files:
            with where.open_input_file(name) as raw:
                yield from self.records(raw)

    def records(self, raw) -> Iterator[tuple]:
        import io

        with io.BufferedReader(raw, 1 << 20) as stream:
            while (header := read_header(stream)) is not None:
                length, row = int(header["content-length"]), columns_of(header)
                if any(row[c] not in values for c, values in self.wanted.items()):
                    stream.seek(length, 1)
                    continue
                if self.with_payload:
                    payload = stream.read(length)
                else:
                    payload = None
                    stream.seek(length, 1)
                yield (*row.values(), payload)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload`` and ``groupBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives written from ``pages`` to the shared folder, read back record by record.

    Digest and length are checked against the payload where a record has one.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path)
    whole = (F.col("record_type") == "revisit") | ((base32_sha1(F.col("payload")) == F.col("payload_digest"))
                                                   & (F.octet_length("payload") == F.col("payload_bytes")))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged WARC record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string"))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
