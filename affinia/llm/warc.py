"""WARC archives as a PySpark data source, and revisit dedup of equal payloads.

Writing: every task writes archives of gzip members, one per record, with the
`sl` extra field (member size, record size) so that a reader can step over a
member without unpacking it. A file counts once the driver has listed it in a
manifest, so files of failed attempts are never read.

Reading: the driver plans one partition per archive. Equality and IN predicates
on `record_type` and the other header columns are pushed down: a reader unpacks a
record's headers first, tests them, and unpacks the payload only of records that
pass, and only with the option `payload`. Archives without the `sl` field and
uncompressed `.warc` files are read as well.

Options: `payload` (false: the payload column is null and no body is unpacked),
`verify` (true: an unpacked payload must fit its digest), `max_file_bytes`,
`date`. Columns written: record_id, record_type, target_uri, payload_digest (bare
base32 SHA-1), payload_bytes, refers_to, payload; further columns are ignored.

Defined results for pages: null html is an empty payload; a null url leaves out
the target URI; of equal payloads the largest page id is the response, rows that
repeat that id are responses too, all others (a null id included) are revisits
to it; an empty table writes no records and reads back none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from affinia.session import scratch_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, "
    "refers_to string, payload binary"
)
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_BYTES = 4096


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    if re.match(r"file:/[^/]", path):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head of its response and no body."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_clean(row['record_id'])}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_clean(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field `sl` holds the sizes of the member and of the record."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    size = len(head) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("max_file_bytes", 256 << 20))
        self.date = options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):  # a row at a time: a batch may hold long payloads
                row = {name: batch.column(name)[i].as_py() for name in (*HEADER_COLUMNS, "payload_bytes", "payload")}
                member = gzip_member(record_bytes(row, self.date))
                if out is None or size + len(member) > self.limit:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, path = filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{path}/{f}")


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _columns(head: dict[str, str]) -> dict:
    digest = head.get("warc-payload-digest", "")
    return {
        "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
        "payload_digest": digest.partition(":")[2] or digest or None, "refers_to": head.get("warc-refers-to"),
    }


def _length(fields: dict[str, str]) -> int | None:
    value = fields.get("content-length", "")
    return int(value) if value.isdigit() else None


class _Member:
    """Bytes of one record, unpacked only as far as they are asked for."""

    def __init__(self, file, at: int, gz: bool) -> None:
        self.file, self.at, self.gz = file, at, gz
        self.data, self.size, self.next = b"", None, None
        if gz:
            file.seek(at)
            first = file.read(12 + 64)
            if first[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at {at}")
            if first[3] & 4:
                extra = first[12 : 12 + struct.unpack("<H", first[10:12])[0]]
                while len(extra) >= 4:
                    n = struct.unpack("<H", extra[2:4])[0]
                    if extra[:2] == b"sl" and n == 8:
                        self.size = struct.unpack("<I", extra[4:8])[0]
                        self.next = at + self.size
                    extra = extra[4 + n :]
            self.unpack = zlib.decompressobj(31)
        self.read_at = at

    def more(self, size: int) -> bool:
        """Unpack some more of the record; False at its end."""
        if not self.gz:
            self.file.seek(self.read_at)
            got = self.file.read(size)
            self.read_at += len(got)
            self.data += got
            return bool(got)
        if self.unpack.eof:
            return False
        packed = self.unpack.unconsumed_tail
        if not packed:
            self.file.seek(self.read_at)
            packed = self.file.read(size)
            self.read_at += len(packed)
        got = self.unpack.decompress(packed, size)
        self.data += got
        if self.unpack.eof:
            self.next = self.read_at - len(self.unpack.unused_data)
        elif not packed and not got:
            raise ValueError(f"cut gzip member at {self.at}")
        return True

    def upto(self, mark: bytes, start: int) -> int:
        while (found := self.data.find(mark, start)) < 0:
            if not self.more(HEAD_BYTES):
                return -1
        return found


def read_records(file, total: int, gz: bool, payload: bool, verify: bool, wanted) -> Iterator[dict]:
    """Header columns, payload size and, if asked for, payload of the records that `wanted` accepts."""
    at = 0
    while at < total:
        member = _Member(file, at, gz)
        end = member.upto(b"\r\n\r\n", 0)
        if end < 0:
            if member.data.strip():
                raise ValueError(f"cut record at {at}")
            return
        fields = _headers(member.data[:end])
        row, body, length = _columns(fields), end + 4, _length(fields) or 0
        if not gz:
            member.next = at + body + length + 4
        if wanted(row):
            http = fields.get("content-type", "").startswith("application/http")
            split = member.upto(b"\r\n\r\n", body) if http else body - 4
            inner = _headers(member.data[body:split]) if http and split >= 0 else {}
            size = body + length - split - 4 if split >= 0 else 0
            row["payload"] = None
            row["payload_bytes"] = _length(inner) if row["record_type"] == "revisit" else size
            if payload and row["record_type"] != "revisit":
                chunks = max(HEAD_BYTES, min(size, 1 << 20))
                parts, have = [member.data], len(member.data)
                while have < body + length:  # gathered in a list: a payload may be long
                    member.data = b""
                    if not member.more(chunks):
                        raise ValueError(f"cut record at {at}")
                    parts.append(member.data)
                    have += len(member.data)
                row["payload"] = b"".join(parts)[split + 4 : body + length]
                if verify and row["payload_digest"] and base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != row["payload_digest"]:
                    raise ValueError(f"payload of {row['record_id']} does not fit its digest")
            yield row
        while member.next is None:
            member.data = b""
            member.more(1 << 16)
        at = member.next


@dataclass
class Archive(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "false")).lower() == "true"
        self.verify = str(options.get("verify", "true")).lower() == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((f.attribute[0], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        listed = [f for f in found if f.base_name.startswith("_manifest-")]
        names = set()
        for f in listed:
            with fs.open_input_stream(f.path) as src:
                names.update(json.loads(src.read()))
        archives = [f for f in found if f.base_name.endswith((".warc", ".warc.gz")) and (not listed or f.base_name in names)]
        return [Archive(f.path, f.size) for f in sorted(archives, key=lambda f: -f.size)] or [Archive("", 0)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        names = [*HEADER_COLUMNS[:4], "payload_bytes", "refers_to", "payload"]
        types = [*[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        def wanted(row: dict) -> bool:
            return all(row[name] in values for name, values in self.tests)

        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for row in read_records(file, partition.size, partition.path.endswith(".gz"), self.payload, self.verify, wanted):
                rows.append(row)
                held += 200 + len(row["payload"] or b"")
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload_bytes: int = 0
) -> DataFrame:
    """The columns that the writer takes: of equal payloads one response, the others revisits.

    Only ids and digests meet in the search for equal payloads; the pages themselves
    are dealt out once, by their own id.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("payload"),
        F.sha1(body).alias("_sha"), F.octet_length(body).cast("bigint").alias("payload_bytes"),
    )
    keys = rows.where(F.col("payload_bytes") >= min_payload_bytes).select("_id", "_sha", "payload_bytes")
    latest = keys.groupBy("_sha", "payload_bytes").agg(F.max("_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null")
    revisits = (
        keys.join(latest, ["_sha", "payload_bytes"])
        .where(~F.col("_id").eqNullSafe(F.col("_last")))
        .select(F.col("_id").alias("_rid"), F.col("_sha").alias("_rsha"), "_last")
        .distinct()
    )
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_sha") == F.col("_rsha"))
    revisit = F.col("_last").isNotNull()

    def urn(col: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit(">"))

    return rows.join(revisits, same, "left").select(
        urn("_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        base32("_sha").alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, urn("_last")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(hex_col: str):
    """Bare upper-case base32 of a 40-digit hex string: 5 digits give 4 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(0, 40, 5):
        number = F.conv(F.substring(hex_col, k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_pages(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write one record per page to WARC archives under `path` (by default a fresh shared folder)."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read_warc(spark, path: str, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the archives give them back.

    Bodies are unpacked, and held against their digests, for responses alone.
    """
    spark = pages.sparkSession
    path = write_pages(pages, path, **columns)

    def page(col: str):
        return F.regexp_extract(col, "^<urn:page:(.*)>$", 1).try_cast("bigint")

    responses = read_warc(spark, path, payload=True).where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    revisits = read_warc(spark, path).where("record_type = 'revisit'")
    return responses.unionByName(revisits).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
