"""WARC records in ZIP packages: writer, directory reader and range reader.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, a
WARC file of one gzip member per record, and ``indexes/index.cdxj``, a line for each
record with its offset and length in the archive. The reader never extracts a package:
it finds the end-of-central-directory record (and the ZIP64 one where sizes or counts
need it), reads the central directory and the members' local headers, then the stored
index, and from then on reads each record by its byte range. Ranges of any package are
read by any task, so one large package is spread over the cluster.

Defined results
---------------
* null html: an empty payload. null url: an empty target. Line breaks in a url are percent-encoded.
* records with equal payloads of at least ``revisit_bytes`` bytes: that with the largest
  page_id is a response, others revisit it; rows that repeat that page_id are responses too.
* null page_id: always a response, read back as null.
* repeated page_ids: a record each, and as the id of a record follows from the page_id, ids repeat with it.
* very long payloads: a record is held whole, as bytes and compressed, by the task that writes and the one that reads it.
* ties: rows with the largest page_id of equal payloads are all responses.
* empty table: no package, no record. Further columns, whatever their names, are passed over.
* a member that is compressed or encrypted, a directory that runs over the file and a
  record or ZIP64 field that is cut off raise ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .common import require, written

REVISIT_BYTES = 1000
#: Bytes of archive after which a task begins another package.
PACKAGE_BYTES = 32 << 20
#: Bytes of adjoining records that one read fetches.
RANGE_BYTES = 4 << 20
BROADCAST_ROWS = 500_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed date of the records, so that a task that is run again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
URN = "urn:millrace:page:"


def warc_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    own = "null-" + hashlib.sha1(url.encode() + payload).hexdigest() if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{own}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one WARC record."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    at = raw.find(b"\r\n\r\n")
    if at < 0:
        raise ValueError("the record's head is cut off")
    head = {}
    for line in raw[:at].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    size = int(head["content-length"])
    body = raw[at + 4 : at + 4 + size]
    if len(body) < size:
        raise ValueError("the record is cut off")
    cut = body.find(b"\r\n\r\n")
    return {"type": head.get("warc-type"), "id": head.get("warc-record-id", "")[1:-1], "refers_to": head.get("warc-refers-to", "")[1:-1] or None, "url": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest"), "payload": body[cut + 4 :] if cut >= 0 else body}


def package(archive: bytes, index: bytes, zip64: bool = False) -> bytes:
    """A ZIP package of stored members; ``zip64`` forces the large forms, which else come where sizes need them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        meta = json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": len(archive)}, {"path": INDEX, "bytes": len(index)}]}).encode()
        for name, data in ((DATA, archive), (INDEX, index), ("datapackage.json", meta)):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(data)
    raw = out.getvalue()
    return _large_directory(raw) if zip64 else raw


def _large_directory(raw: bytes) -> bytes:
    """The same package with a ZIP64 end record and all ones in the short one."""
    at = raw.rindex(b"PK\x05\x06")
    _, _, _, here, count, size, offset, _ = struct.unpack("<IHHHHIIH", raw[at : at + 22])
    large = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, here, count, size, offset)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at, 1)
    return raw[:at] + large + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


# ------------------------------------------------------------------ directory


def _wide(extra: bytes, sizes: list[int]) -> list[int]:
    """``sizes`` (usize, csize, offset) with all-ones values taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(sizes):
                if v == 0xFFFFFFFF:
                    if len(field) < k + 8:
                        raise ValueError("a ZIP64 extra field is cut off")
                    (sizes[i],) = struct.unpack_from("<Q", field, k)
                    k += 8
            break
        at += 4 + n
    return sizes


def directory(f: store.Reader) -> Iterator[dict]:
    """The central directory's members: name, method, flags, size and the offset of the local header. It is read in pieces."""
    tail_size = min(f.size, 22 + 0xFFFF + 20)
    tail = f.read(f.size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end = f.size - tail_size + at
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = f.read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            (where,) = struct.unpack_from("<Q", locator, 8)
            large = f.read(where, 56)
            if large[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, offset = struct.unpack_from("<QQQ", large, 32)
    if offset + size > end:
        raise ValueError("the central directory runs over the file")
    held, start, stop = b"", offset, offset + size
    for _ in range(count):
        while True:
            if len(held) >= 46:
                n, m, k = struct.unpack_from("<HHH", held, 28)
                if len(held) >= 46 + n + m + k:
                    break
            if start >= stop:
                raise ValueError("the central directory is cut off")
            piece = min(1 << 20, stop - start)
            held += f.read(start, piece)
            start += piece
        if held[:4] != b"PK\x01\x02":
            raise ValueError("no central directory entry")
        flags, method = struct.unpack_from("<HH", held, 8)
        csize, usize = struct.unpack_from("<II", held, 20)
        (local,) = struct.unpack_from("<I", held, 42)
        name = held[46 : 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        usize, csize, local = _wide(held[46 + n : 46 + n + m], [usize, csize, local])
        held = held[46 + n + m + k :]
        yield {"name": name, "method": method, "flags": flags, "size": csize, "local": local}


def stored_range(f: store.Reader, member: dict) -> tuple[int, int]:
    """Where a stored member's bytes lie in the package."""
    if member["method"] != 0 or member["flags"] & 1:
        raise ValueError(f"{member['name']} is not stored plainly")
    head = f.read(member["local"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n, m = struct.unpack_from("<HH", head, 26)
    start = member["local"] + 30 + n + m
    if start + member["size"] > f.size:
        raise ValueError(f"{member['name']} runs over the file")
    return start, member["size"]


def record_ranges(uri: str) -> Iterator[tuple[int, int]]:
    """(offset, length) in the package of every record that its stored index names, in archive order."""
    with store.Reader(uri) as f:
        members = {m["name"]: m for m in directory(f)}
        archives = {name.rsplit("/", 1)[-1]: stored_range(f, m) for name, m in members.items() if name.startswith("archive/")}
        for name, m in members.items():
            if not (name.startswith("indexes/") and name.endswith(".cdxj")):
                continue
            start, size = stored_range(f, m)
            rest = b""
            for at in range(0, size, 1 << 20):
                lines = (rest + f.read(start + at, min(1 << 20, size - at))).split(b"\n")
                rest = lines.pop()
                for line in filter(None, lines):
                    yield _line(line, archives)
            if rest:
                yield _line(rest, archives)


def _line(line: bytes, archives: dict[str, tuple[int, int]]) -> tuple[int, int]:
    entry = json.loads(line[line.index(b"{") :])
    start, size = archives[entry["filename"]]
    offset, length = int(entry["offset"]), int(entry["length"])
    if offset + length > size:
        raise ValueError("a record runs over its archive")
    return start + offset, length


# ------------------------------------------------------------------ Spark side


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to (null for a response). Only groups of equal payloads are joined, each spread over 16 salts."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keys = [F.sha1(F.col("html")).alias("sha"), F.octet_length("html").alias("size")]
    many = rows.where(F.octet_length("html") >= revisit_bytes).groupBy(*keys).agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first != last").select("sha", "size", "last")
    many = written(many, "payloads")
    keyed = rows.select("*", *keys)
    if many.count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(many), ["sha", "size"], "left")
    else:
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        out = keyed.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(16))).join(salted, ["sha", "size", "salt"], "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes (page_id, url, html, refers_to) as packages under ``folder``; gives their uri, size and number of records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        data, lines = bytearray(), []

        def done() -> pd.DataFrame:
            uri = f"{folder}/{part:06d}-{number:04d}.wacz"
            raw = package(bytes(data), b"".join(sorted(lines)), zip64)
            store.put(uri, raw)
            return pd.DataFrame({"uri": [uri], "size": [len(raw)], "records": [len(lines)]})

        for b in batches:
            for page_id, url, html, refers_to in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                url = url.replace("\r", "%0D").replace("\n", "%0A") if isinstance(url, str) else ""
                raw = gzip.compress(warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to), 1, mtime=0)
                entry = {"url": url, "filename": DATA.rsplit("/", 1)[-1], "offset": str(len(data)), "length": str(len(raw))}
                lines.append(f"{url.replace(' ', '%20') or '-'} {DATE} {json.dumps(entry)}\n".encode("utf-8", "surrogatepass"))
                data += raw
                if len(data) >= package_bytes:
                    yield done()
                    data, lines, number = bytearray(), [], number + 1
        if lines:
            yield done()

    typed = rows.select("page_id", "url", "html", "refers_to")
    return typed.mapInPandas(run, "uri string, size bigint, records bigint")


def plan_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of adjoining records (uri, start, length, lengths of the records), from the packages' directories and indexes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["uri"]:
                out, own, start, end = [], [], 0, -1
                for offset, length in sorted(record_ranges(uri)):
                    if own and (offset != end or end - start + length > range_bytes):
                        out.append((uri, start, end - start, own))
                        own = []
                    if not own:
                        start = offset
                    own.append(length)
                    end = offset + length
                if own:
                    out.append((uri, start, end - start, own))
                yield pd.DataFrame(out, columns=["uri", "start", "length", "records"])

    return packages.select("uri").mapInPandas(run, "uri string, start bigint, length bigint, records array<bigint>")


def read_records(ranges: DataFrame) -> DataFrame:
    """The records of ``plan_ranges``: record_id, record_type, refers_to, url, digest (as stated) and payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, start, length, sizes in zip(b["uri"], b["start"], b["length"], b["records"], strict=True):
                with store.Reader(uri) as f:
                    raw = f.read(int(start), int(length))
                out, at = [], 0
                for n in sizes:
                    inflate = zlib.decompressobj(31)
                    record = inflate.decompress(raw[at : at + n])
                    if not inflate.eof:
                        raise ValueError("a record's gzip member is cut off")
                    r = parse_record(record)
                    out.append((r["id"], r["type"], r["refers_to"], r["url"], r["digest"], r["payload"]))
                    at += int(n)
                yield pd.DataFrame(out, columns=["record_id", "record_type", "refers_to", "url", "digest", "payload"])

    return ranges.mapInPandas(run, "record_id string, record_type string, refers_to string, url string, digest string, payload binary")


def page_of(urn: str):
    """The page_id in a record id; null for pages without one."""
    return F.expr(f"try_cast(substring({urn}, {len(URN) + 1}) as bigint)")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type and refers_to: revisits take the payload's size and digest from their response."""
    digest = F.sha1("payload")
    own = written(records.select(page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to")), "records")
    referred = own.where("record_type = 'revisit'").select(F.col("refers_to").alias("_to")).distinct()
    full = own.where("record_type = 'response'").join(referred, F.col("page_id") == F.col("_to"), "left_semi").groupBy(F.col("page_id").alias("refers_to")).agg(F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d"))
    full = written(full, "referred")
    if full.count() <= BROADCAST_ROWS:
        both = own.join(F.broadcast(full), "refers_to", "left")
    else:  # one payload may have a third of all revisits
        salted = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        both = own.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(16))).join(salted, ["refers_to", "salt"], "left")
    revisit = F.col("record_type") == "revisit"
    return both.select("page_id", F.when(revisit, F.col("b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as packages under ``folder`` and reads them back."""
    require(pages, "page_id", "url", "html")
    packages = written(write_packages(with_revisits(pages), folder, package_bytes, zip64), "packages")
    ranges = written(plan_ranges(packages), "ranges")
    return resolved(read_records(ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism)))
