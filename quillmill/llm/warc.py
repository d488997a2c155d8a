"""Web archives packed in ZIP files, written and read without unpacking.

An archive holds stored (uncompressed) members: WARC data whose records are gzip members of their own, and an index
with a line for each record. The reader parses the central directory, with the ZIP64 records that large archives have,
finds the members, and reads single records by offset and length. Archives are files in the shared folder, written and
read by the tasks themselves through pyarrow's file systems, which know local and remote storage; a table lists those
that count, so that what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from quillmill.llm.common import bound_batches, qualified

#: Fixed values of the formats.
LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 1
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date: reruns write the same bytes.
DATE, STAMP = "2024-01-01T00:00:00Z", "20240101000000"
#: An archive is closed beyond this many bytes of data. A task holds one.
ARCHIVE_BYTES = 32 << 20


class ZipIndex:
    """The members of a ZIP file: name -> (offset of the data, stored size). read(start, length) gets bytes of the file."""

    def __init__(self, read, size: int) -> None:
        self.read, self.members = read, {}
        tail_at = max(0, size - 22 - MAX16)
        tail = read(tail_at, size - tail_at)
        at = self._end(tail)
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if MAX16 == count or MAX32 in (length, start):
            sign, _, end64, _ = struct.unpack("<IIQI", read(tail_at + at - 20, 20))
            if sign != LOCATOR64:
                raise ValueError("ZIP64 locator missing")
            record = read(end64, 56)
            if struct.unpack_from("<I", record)[0] != END64:
                raise ValueError("ZIP64 end record missing")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self._directory(read(start, length), count)

    @staticmethod
    def _end(tail: bytes) -> int:
        mark = struct.pack("<I", END)
        at = tail.rfind(mark)
        while at >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return at
            at = tail.rfind(mark, 0, at)
        raise ValueError("not a ZIP file")

    def _directory(self, data: bytes, count: int) -> None:
        at = 0
        for _ in range(count):
            sign, method, packed, full, n_name, n_extra, n_note, offset = *struct.unpack_from("<I6xH", data, at), *struct.unpack_from("<IIHHH", data, at + 20), struct.unpack_from("<I", data, at + 42)[0]
            if sign != CENTRAL:
                raise ValueError("central directory damaged")
            name = data[at + 46 : at + 46 + n_name].decode()
            wide = self._wide(data[at + 46 + n_name : at + 46 + n_name + n_extra])
            full = next(wide) if full == MAX32 else full
            packed = next(wide) if packed == MAX32 else packed
            offset = next(wide) if offset == MAX32 else offset
            if method == 0:
                self.members[name] = (offset, packed)
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == EXTRA64:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
            at += 4 + n

    def slice(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """Part of a stored member."""
        offset, size = self.members[name]
        sign, n_name, n_extra = struct.unpack("<I22xHH", self.read(offset, 30))
        if sign != LOCAL:
            raise ValueError("local header damaged")
        length = size - start if length is None else length
        if start < 0 or length < 0 or start + length > size:
            raise ValueError("range outside the member")
        return self.read(offset + 30 + n_name + n_extra + start, length)


def pack_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with zip64, or where sizes need it, with the wide records."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= MAX32 or at >= MAX32
        extra = struct.pack("<HHQQ", EXTRA64, 16, n, n) if wide else b""
        extra_c = struct.pack("<HHQQQ", EXTRA64, 24, n, n, at) if wide else b""
        shown, where, version = (MAX32, MAX32, 45) if wide else (n, at, 20)
        out += [struct.pack("<IHHHHHIIIHH", LOCAL, version, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)), raw, extra, data]
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, version, version, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra_c), 0, 0, 0, 0, where) + raw + extra_c)
        at += 30 + len(raw) + len(extra) + n
    central, count = b"".join(directory), len(members)
    wide = zip64 or at >= MAX32 or count >= MAX16
    if wide:
        out.append(central + struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, len(central), at) + struct.pack("<IIQI", LOCATOR64, 0, at + len(central), 1))
        out.append(struct.pack("<IHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
    else:
        out.append(central + struct.pack("<IHHHHIIH", END, 0, 0, count, count, len(central), at, 0))
    return b"".join(out)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    last = urn.strip("<>").rsplit(":", 1)[1]
    return None if last == "null" else int(last)


def warc_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One response or revisit record. A revisit has the HTTP header, with the payload's length, but no payload."""
    clean = "".join(x if 32 < ord(x) else f"%{ord(x):02X}" for x in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean}"] * (url is not None) + [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record, header names lower-cased."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {warc.get('warc-record-id')} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(rows: Iterable[tuple], archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> Iterator[bytes]:
    """Archives of (page_id, url, payload, refers_to, revisit) rows, closed as they reach archive_bytes."""
    data, index, at = [], [], 0

    def closed() -> bytes:
        return pack_zip([(DATA, b"".join(data)), (INDEX, "\n".join(index).encode())], zip64)

    for page_id, url, payload, refers_to, revisit in rows:
        packed = gzip.compress(warc_record(page_id, url, payload, refers_to, revisit), 1, mtime=0)
        about = {"offset": str(at), "length": str(len(packed)), "filename": DATA, "digest": "sha1:" + payload_digest(payload)}
        index.append(f"{json.dumps(url or '')[1:-1].replace(' ', '%20')} {STAMP} {json.dumps(about)}")
        data.append(packed)
        at += len(packed)
        if at >= archive_bytes:
            yield closed()
            data, index, at = [], [], 0
    if data:
        yield closed()


def read_archive(read, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of an archive, each by a range read that its index names."""
    z = ZipIndex(read, size)
    for name in [x for x in z.members if x.startswith("indexes/")]:
        for line in z.slice(name).decode().split("\n"):
            about = json.loads(line.split(" ", 2)[2])
            yield parse_record(gzip.decompress(z.slice(about["filename"], int(about["offset"]), int(about["length"]))))


def _write(folder: str, archive_bytes: int, zip64: bool):
    """Writes archives to folder, each under a name that no other attempt of the task has; gives their names and sizes."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def rows():
            for b in batches:
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield page_id, url, (html or "").encode(), refers_to, revisit

        for archive in write_archives(rows(), archive_bytes, zip64):
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(archive)
            yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "size": pa.array([len(archive)], pa.int64())})

    return write


def _read(folder: str):
    """Reads the records of listed archives: of each file the directory, the index, and the range of each record, nothing else."""
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = []
                with store.open_input_file(f"{root}/{name}") as f:
                    for warc, http, payload in read_archive(lambda start, n, f=f: f.read_at(n, start), size):
                        kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"record {warc['warc-record-id']}: payload and digest differ")
                        refers_to = _id(warc["warc-refers-to"]) if kind == "revisit" else None
                        out.append((_id(warc["warc-record-id"]), int(http["content-length"]), digest, kind, refers_to))
                yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(kinds.items())})

    return read


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Only digests meet by payload; pages are dealt by their id."""
    rows = pages.select("page_id", "url", "html").withColumn("__sha", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    ids = rows.where(large).select("page_id", "__sha")
    last = ids.groupBy("__sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = ids.join(last, "__sha").where(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("__id"), F.col("__sha").alias("__s"), "last").distinct()
    found = rows.join(others, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__s")), "left")
    return found.select("page_id", "url", "html", F.col("last").alias("refers_to"), F.col("__s").isNotNull().alias("revisit"))


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = True) -> None:
    """Writes archives with a record for each row of pages to path/files, and the table of them, name and size, to path/listed.

    Of pages with equal payloads of least_bytes or more, that with the largest page_id is a response and the others
    revisit it; rows that repeat an id and its payload are of one kind. A null page_id comes before all others, a null
    url is left out, control characters in a url are percent-encoded, null html is an empty payload. Long payloads are
    written whole; other columns are not read; an empty table gives no archives. Unless told otherwise archives have the
    wide records of ZIP64, which sizes beyond 4 GB need.
    """
    bound_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, f"{path}/files")
    deduplicated(pages, least_bytes).mapInArrow(_write(folder, archive_bytes, zip64), "name string, size bigint").write.parquet(f"{path}/listed")


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the archives that path/listed names."""
    listed = spark.read.parquet(f"{path}/listed").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a row each: they would come in one split
    return listed.mapInArrow(_read(qualified(spark, f"{path}/files")), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def query(spark, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold. It is read back at once, and the archives go."""
    from quillmill.llm.common import read, remove, scratch_table, settle

    path = scratch_table(spark, "archives")
    try:
        archive_pages(read(spark, sf_dir, "pages"), path)
        return settle(read_archives(spark, path))
    finally:
        remove(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
