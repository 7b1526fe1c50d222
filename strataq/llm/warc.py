"""WARC files as a PySpark Python data source, with pushdown and skipped payloads.

Written files are ``.warc.gz`` with one gzip member per record. Members carry the skip-length field
``sl`` that the WARC standard describes, so a reader inflates a record's head, tests the pushed-down
predicates and seeks over the payload it does not want. Members without the field, as other writers
make them, are inflated to find their end; in plain ``.warc`` files the reader seeks by Content-Length.
Writers roll files at ``max_file_bytes``. ``_committed-*`` lists name the files of finished jobs, so
what lost tasks left behind is not read; files with names of other writers are always read. A payload
of any length is one value and has to fit a task's memory; payloads that are not wanted are never held.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from strataq.llm.exact_dedup import digest_of
from strataq.storage import materialize, new_path, read_table

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length bigint, refers_to string, payload binary"
#: Columns that pushed-down predicates may name, with their header.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
LENGTH, ESCAPED = "X-Payload-Length", "X-Percent-Encoded"
#: Begins the names of files that are read only if a ``_committed-*`` list names them.
OWN = "strataq-"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STEP = 1 << 16
MAX_HEAD = 1 << 24


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def _escaped(value: str) -> str:
    """A value that a header line cannot hold as it is, percent-encoded where it has to be."""
    return re.sub(r"[%\r\n \t]", lambda m: f"%{ord(m[0]):02X}", value)


def _unescaped(value: str) -> str:
    return re.sub(r"%(25|0D|0A|20|09)", lambda m: chr(int(m[1], 16)), value)


def pack(fields: dict[str, str | None], payload: bytes) -> bytes:
    """One record as a gzip member with its skip lengths.

    Values stand as they are, but for those with line ends or blanks at an end: these are
    percent-encoded, and a header of our own names them.
    """
    block = HTTP_HEAD + payload
    head = {"WARC-Date": "2020-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response"} | fields | {"Content-Length": str(len(block))}
    odd = [k for k, v in head.items() if v is not None and ("\r" in v or "\n" in v or v != v.strip(" \t"))]
    head = {k: _escaped(v) if k in odd else v for k, v in head.items()} | ({ESCAPED: " ".join(odd)} if odd else {})
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    raw = b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    # The sizes of the member and of its content; a size beyond 4 GB is given as 0, which readers take as unknown.
    total = 10 + 2 + 12 + len(body)
    sizes = (total, len(raw)) if max(total, len(raw)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, *sizes) + body


def _head(f) -> tuple[int, int] | None:
    """Read a member's gzip head: its start and, if given, its size; None at the end of the file."""
    start = f.tell()
    head = f.read(10)
    if len(head) < 10:
        return None
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at {start}")
    size = 0
    if head[3] & 4:
        extra = f.read(struct.unpack("<H", f.read(2))[0])
        at = 0
        while at + 4 <= len(extra):
            name, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if name == b"sl" and n == 8:
                size = struct.unpack_from("<I", extra, at + 4)[0]
            at += 4 + n
    for flag in (8, 16):
        if head[3] & flag:
            while f.read(1) not in (b"\0", b""):
                pass
    if head[3] & 2:
        f.read(2)
    return start, size


def _fields(head: bytes) -> dict[str, str]:
    """Header values by lower-case name; a line that begins with a blank goes on with the one before it."""
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    out: dict[str, str] = {}
    name = ""
    for line in text.split("\r\n" if "\r\n" in text else "\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip(" \t")
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip(" \t").lower()
            out[name] = value.strip(" \t")
    for name in out.get(ESCAPED.lower(), "").lower().split():
        out[name] = _unescaped(out[name])
    return out


class Parser:
    """Cuts a stream of bytes into records; holds a record's head, and its block only where it is wanted."""

    def __init__(self, wanted):
        self.wanted, self.buffer, self.left, self.level, self.fields, self.seen = wanted, bytearray(), None, 0, {}, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Headers and block, or None in its place, of the records that end in ``data`` and are wanted."""
        self.buffer += data
        while True:
            if self.left is None:
                start = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
                del self.buffer[:start]
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    if len(self.buffer) > MAX_HEAD:
                        raise ValueError(f"a record's head is longer than {MAX_HEAD} bytes")
                    return
                if not self.buffer.startswith(b"WARC/"):
                    raise ValueError("a record does not begin with its version")
                self.fields = _fields(bytes(self.buffer[:end]))
                if "content-length" not in self.fields:
                    raise ValueError("a record has no Content-Length")
                self.left, self.level = int(self.fields["content-length"]), self.wanted(self.fields)
                self.seen += 1
                del self.buffer[: end + 4]
            if self.level < 2:
                gone = min(self.left, len(self.buffer))
                del self.buffer[:gone]
                self.left -= gone
                if self.left:
                    return
                block = None
            elif len(self.buffer) < self.left:
                return
            else:
                block = bytes(self.buffer[: self.left])
                del self.buffer[: self.left]
            self.left = None
            if self.level:
                yield self.fields, block

    def skips(self) -> bool:
        """Whether the rest of the record at hand is of no use."""
        return self.left is not None and self.level < 2

    def check(self, where: int) -> None:
        if self.left is not None or self.buffer.strip(b"\r\n"):
            raise ValueError(f"the record at {where} is cut off")


def records(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, by lower-case name, and block of the records of a ``.warc.gz`` for which ``wanted(headers)`` is 2, headers alone where it is 1."""
    while (found := _head(f)) is not None:
        start, size = found
        z, parser = zlib.decompressobj(-15), Parser(wanted)
        while not z.eof:
            chunk = z.unconsumed_tail or f.read(STEP)
            if not chunk:
                raise ValueError(f"the record at {start} is cut off")
            yield from parser.feed(z.decompress(chunk, STEP))
            # A member with a skip length holds one record.
            if size and parser.seen == 1 and parser.skips():
                if parser.level:
                    yield parser.fields, None
                break
        else:
            parser.check(start)
        f.seek(start + size if size else f.tell() - len(z.unused_data) + 8)


def plain_records(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The same of a ``.warc`` file that is not compressed."""
    parser, start = Parser(wanted), 0
    while chunk := f.read(STEP):
        yield from parser.feed(chunk)
        if parser.skips():
            f.seek(parser.left, 1)
            if parser.level:
                yield parser.fields, None
            parser.left = None
        start += len(chunk)
    parser.check(start)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.payload = options.get("payload", "true") == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, (EqualTo, In)) and len(x.attribute) == 1 and x.attribute[0] in HEADERS:
                self.tests.append((x.attribute[0], tuple(x.value) if isinstance(x, In) else (x.value,)))
            else:
                yield x

    def partitions(self):
        """Committed files, small ones together up to ``partition_bytes``."""
        from pyarrow import fs

        store, root = _fs(self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        names: set[str] | None = None
        for x in infos:
            if x.base_name.startswith("_committed-"):
                with store.open_input_file(x.path) as f:
                    names = (names or set()) | set(json.loads(f.read()))
        names = names or set()
        ours = lambda n: n.startswith(OWN) and n not in names
        files = sorted((x.path, x.size) for x in infos if x.base_name.endswith((".warc.gz", ".warc")) and not ours(x.base_name))
        out: list[Files] = []
        some: list[str] = []
        total = 0
        for path, size in files:
            if some and total + size > self.bytes:
                out.append(Files(tuple(some)))
                some, total = [], 0
            some.append(path)
            total += size
        return [*out, Files(tuple(some))]

    def _wanted(self, fields: dict[str, str]) -> int:
        for name, values in self.tests:
            if _column(fields, name) not in values:
                return 0
        return 2 if self.payload and fields.get("warc-type") != "revisit" else 1

    def read(self, partition):
        store, _ = _fs(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for fields, block in (records if path.endswith(".gz") else plain_records)(f, self._wanted):
                    payload = block
                    if block is not None and block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
                        payload = block[end + 4 :]
                    length = fields.get(LENGTH.lower())
                    own = [_column(fields, k) for k in ("record_id", "record_type", "target_uri", "payload_digest")]
                    yield (*own, int(length) if length is not None else None, _column(fields, "refers_to"), payload)


def _column(fields: dict[str, str], name: str) -> str | None:
    value = fields.get(HEADERS[name].lower())
    return value.removeprefix("sha256:") if value is not None and name == "payload_digest" else value


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("max_file_bytes", 256 << 20))

    def write(self, iterator):
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        f = None
        for row in iterator:
            if f is None:
                names.append(f"{OWN}{uuid.uuid4().hex}.warc.gz")
                f, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            digest = row["payload_digest"]
            fields = {
                "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Target-URI": row["target_uri"],
                "WARC-Payload-Digest": None if digest is None else f"sha256:{digest}", "WARC-Refers-To": row["refers_to"],
                LENGTH: None if row["payload_length"] is None else str(row["payload_length"]),
            }
            if row["record_type"] == "revisit":
                fields["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
            member = pack(fields, bytes(row["payload"] or b""))
            f.write(member)
            size += len(member)
            if size >= self.most:
                f.close()
                f = None
        if f is not None:
            f.close()
        return Written(names)

    def commit(self, messages):
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        store, root = _fs(self.path)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc").mode("append")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


def archive(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``.

    Of equal payloads of at least ``min_bytes`` the one with the smallest page_id is written as
    response, the others as revisits of it without payload. A null html is an empty payload, a null
    url is left out of the head. Rows with a null page_id are responses unless a row with an id has
    the same payload; rows that repeat the smallest page_id are all responses. An empty table gives
    an archive without records.
    """
    register(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), digest_of(F.col("html")).alias("digest"))
    firsts = own.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-firsts")
    rows = own.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    rows.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.lower(F.hex("digest")).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_length"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    ).write.format("warc").mode("append").options(path=path).save()


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def describe(spark: SparkSession, path: str) -> DataFrame:
    """A row per archived page; sizes and digests of responses are taken from the payload that was read back."""
    responses = read_warc(spark, path).where("record_type = 'response'")
    revisits = read_warc(spark, path, payload="false").where("record_type = 'revisit'")
    payload = F.coalesce("payload", F.lit(b""))
    found = responses.select("record_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), "record_type", "refers_to").union(
        revisits.select("record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive(read_table(spark, sf_dir, "pages"), path)
    return describe(spark, path)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
