"""Web archives packed in ZIP files.

Writing: each task packs its rows into one ZIP file: a stored member
``archive/data.warc.gz`` in which every WARC record is a gzip member of its own,
and a stored member ``indexes/index.cdxj`` with a line for each record.  Files
go to the shared folder under a name that no other attempt uses, so a task that
runs again leaves an unused file and no damage.

Reading: the end of the file names the central directory (ZIP64 too); its
entries give the members' places; stored members are never copied out.  The
index is read, then each record by its own byte range.

Both sides use pyarrow file systems, so a folder may be local, shared or in an
object store.

Payloads: of records with equal payloads of ``least`` bytes or more, the one
with the largest id is a response and the others are revisits of it; smaller
ones are all responses.  Defined results: a null payload counts as empty; a null
id is smaller than any other; rows with the largest id and equal payloads are
all responses.  An empty table gives no archive and reads back as no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def opened(path: str):
    """(file system, path) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


# ---- records ------------------------------------------------------------


def record(kind: str, ident: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{ident}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC headers, HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = lambda ls: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in ls)}
    warc = fields(lines[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload


# ---- ZIP files ----------------------------------------------------------


class ZipWriter:
    """Stored members only, written once, front to back."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        if self.entries:
            self.entries[-1][2] += len(data)
            self.entries[-1][3] = zlib.crc32(data, self.entries[-1][3])

    def begin(self, name: str) -> None:
        start, raw = self.at, name.encode()
        held, self.entries = self.entries, []
        # sizes follow in the central directory and in a data descriptor (flag bit 3); ZIP64 throughout
        self.put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        self.entries = [*held, [raw, start, 0, 0]]

    def end(self) -> None:
        held, self.entries = self.entries, []
        self.put(struct.pack("<IIQQ", 0x08074B50, held[-1][3], held[-1][2], held[-1][2]))
        self.entries = held

    def close(self) -> None:
        entries, self.entries, start = self.entries, [], self.at
        for raw, at, size, crc in entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        size, n, end = self.at - start, len(entries), self.at
        self.put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self.put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class ZipReader:
    """Members by name -> (first byte, size), from the central directory alone."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        tail = self.range(max(0, size - 65_557), size)
        at = tail.rfind(b"PK\x05\x06")
        # what follows is a comment of the stated length; else the mark is part of a comment
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if 0xFFFF == n or 0xFFFFFFFF in (length, start):
            mark, _, place, _ = struct.unpack("<IIQI", tail[at - 20 : at])
            if mark != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            n, length, start = struct.unpack("<QQQ", self.range(place, place + 56)[32:56])
        data, at, self.members = self.range(start, start + length), 0, {}
        for _ in range(n):
            mark, method = struct.unpack("<I", data[at : at + 4])[0], struct.unpack("<H", data[at + 10 : at + 12])[0]
            if mark != 0x02014B50:
                raise ValueError("damaged central directory")
            stored, whole, name, extra, comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
            place = struct.unpack("<I", data[at + 42 : at + 46])[0]
            label = data[at + 46 : at + 46 + name].decode()
            more, k = data[at + 46 + name : at + 46 + name + extra], 0
            while k + 4 <= len(more):
                kind, width = struct.unpack("<HH", more[k : k + 4])
                if kind == 1:
                    values = iter(struct.unpack(f"<{width // 8}Q", more[k + 4 : k + 4 + width // 8 * 8]))
                    whole = next(values) if whole == 0xFFFFFFFF else whole
                    stored = next(values) if stored == 0xFFFFFFFF else stored
                    place = next(values) if place == 0xFFFFFFFF else place
                k += 4 + width
            self.members[label] = (method, place, stored)
            at += 46 + name + extra + comment

    def range(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)

    def place(self, name: str) -> tuple[int, int]:
        method, at, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        name_size, extra = struct.unpack("<HH", self.range(at + 26, at + 30))
        first = at + 30 + name_size + extra
        return first, first + size

    def records(self):
        """Every record of the archive, each by its own range."""
        start, end = self.place(INDEX)
        first, _ = self.place(RECORDS)
        for line in self.range(start, end).splitlines():
            entry = json.loads(line)
            at = first + entry["offset"]
            yield parse(gzip.decompress(self.range(at, at + entry["length"])))


# ---- operators ----------------------------------------------------------


SALTS = 32


def planned(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """id, url, payload, digest (SHA-1 in hexadecimal), size, kind and refers_to for each row."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # digests with several rows only, each repeated for every salt: a payload that very many rows share is spread
    again = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.count("*").alias("n"), F.max("id").alias("newest"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), F.col("size").alias("s"), "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SALTS))
    out = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")) & (salt == F.col("salt")), "left")
    old = F.coalesce(F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest")), F.lit(False))
    return out.select("id", "url", "payload", "digest", "size", F.when(old, "revisit").otherwise("response").alias("kind"), F.when(old, F.col("newest")).alias("refers_to"))


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Pack planned records; one row (path, records) for each archive.  Nothing is written before an action."""

    def pack(frames):
        out = zipped = None
        index, at, n, path = [], 0, 0, f"{folder}/{uuid.uuid4().hex}.wacz"
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if out is None:
                    system, place = opened(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place)
                    zipped = ZipWriter(out)
                    zipped.begin(RECORDS)
                text = lambda x: "null" if x is None else x
                digest = base64.b32encode(bytes.fromhex(r.digest)).decode()
                data = gzip.compress(record(r.kind, text(r.id), r.url or "", r.payload.encode("utf-8", "replace"), digest, r.size, text(r.refers_to)), 6, mtime=0)
                zipped.put(data)
                index.append(json.dumps({"id": text(r.id), "offset": at, "length": len(data), "digest": f"sha1:{digest}"}))
                at += len(data)
                n += 1
        if out is not None:
            zipped.end()
            zipped.begin(INDEX)
            zipped.put("\n".join(index).encode())
            zipped.end()
            zipped.close()
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    # ids ride as text: a column of longs with nulls would reach pandas as floats
    shipped = plan.withColumn("id", F.col("id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return shipped.select("id", "url", "payload", "digest", "size", "kind", "refers_to").mapInPandas(pack, "path string, records long")


def read(archives: DataFrame, path: str = "path") -> DataFrame:
    """Every record of every archive, with full payloads where the record holds one."""
    schema = "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"

    def unpack(frames):
        strip = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
        for pdf in frames:
            for p in pdf[path]:
                system, place = opened(p)
                with system.open_input_file(place) as file:
                    rows, held = [], 0
                    for warc, http, payload in ZipReader(file, file.size()).records():
                        whole = warc["warc-type"] == "response"
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"digest of {warc['warc-record-id']} does not match")
                        size = len(payload) if whole else int(http["content-length"])
                        rows.append((strip(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], digest, size, strip(warc.get("warc-refers-to")), payload if whole else None))
                        held += len(payload)
                        if held > 1 << 23 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return archives.select(path).mapInPandas(unpack, schema)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder; the archives' paths and record counts.

    The list of archives is written as a table before it is returned, so that
    no later action packs them again.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write(planned(pages, **columns), folder).write.parquet(f"{folder}/list")
    return spark.read.parquet(f"{folder}/list")
