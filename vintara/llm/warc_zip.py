"""WARC records in ZIP packages, read by range without extraction.

Writing: records of equal payloads are linked first (the smallest key is the response, the others revisit it). Each task then
packs its records, each a gzip member of its own, into packages with two stored members: the archive and its index.

Reading: the end record, the ZIP64 locator and record, and the central directory of a package tell where its stored members
begin; the index member tells where each record begins. Runs of neighbouring records form splits of bounded size, and each split
is one range read of the package. Nothing is unpacked to disk and no package is read whole.

Null payloads are empty, null URLs leave their header out. Payloads under ``SMALLEST`` bytes are always responses. Rows that repeat both
the smallest key and the payload stay responses. A null key is never referred to: such a row revisits a keyed row if there is one, else it is a
response. An empty table gives no package and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import opened, output_folder, partitions, stored, text_rows, with_workers

#: Payloads shorter than this never become revisits.
SMALLEST = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: A package is closed beyond so many bytes; a split covers about so many.
PACKAGE_BYTES, SPLIT_BYTES = 1 << 30, 4 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def linked(frame: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Rows with their payload digest and, for all but the first of equal payloads, the key they refer to."""
    rows = text_rows(frame, key, payload, url).select(
        F.col("key").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), "text",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("size"))
    firsts = (rows.where(F.col("size") >= SMALLEST).groupBy(F.col("digest").alias("same"))
              .agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    refers = F.when((F.col("size") >= SMALLEST) & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, F.col("digest") == F.col("same"), "left").select("key", "url", "text", "digest", refers.alias("refers_to"))


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{URN}{'' if key is None else key}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=";/?:@&=+$,#%~*'()!"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Key, type, reference, digest header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(v) if (v := fields.get(name, "<>")[1:-1].removeprefix(URN)) else None
    return {"key": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
            "told_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "url": fields.get("WARC-Target-URI"),
            "payload": payload if fields["WARC-Type"] == "response" else None}


class Package:
    """Writes one package to a stream that need not be able to go back."""

    def __init__(self, stream):
        self.stream, self.lines, self.at, self.records = stream, [], 0, 0
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, raw: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = pack.compress(raw) + pack.flush()
        self.member.write(packed)
        self.lines.append((self.at, len(packed)))
        self.at += len(packed)
        self.records += 1

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for at, size in self.lines:
                index.write(json.dumps({"offset": at, "length": size}).encode() + b"\n")
        self.zip.close()
        self.stream.close()


def directory(source) -> dict[str, tuple[int, int, int]]:
    """Members of a package: start of their bytes, length, and method, from the central and ZIP64 directories."""
    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (far,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        count, length, offset = struct.unpack("<QQQ", source.read_at(56, far)[32:56])
    raw, at, found = source.read_at(length, offset), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", raw[at + 10 : at + 12])
        packed, plain = struct.unpack("<II", raw[at + 20 : at + 28])
        names, extras, notes = struct.unpack("<HHH", raw[at + 28 : at + 34])
        (local,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + names].decode()
        extra, k = raw[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:  # only fields that overflow are listed, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", extra[k + 4 : k + 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            k += 4 + width
        name_size, extra_size = struct.unpack("<HH", source.read_at(30, local)[26:30])
        found[name] = local + 30 + name_size + extra_size, packed, method
        at += 46 + names + extras + notes
    return found


def write(rows: DataFrame) -> DataFrame:
    """Pack linked rows; returns the manifest, a row per package."""
    with_workers(rows.sparkSession)
    folder = output_folder(rows.sparkSession, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, name = None, ""
        place = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            package.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [package.records]})

        for batch in batches:
            for key, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if package is not None and package.at > PACKAGE_BYTES:
                    yield closed()
                    package = None
                if package is None:
                    system, root = opened(folder)
                    system.create_dir(root, recursive=True)
                    file = f"part-{place:05d}-{uuid.uuid4().hex}.zip"
                    package, name = Package(system.open_output_stream(f"{root}/{file}")), f"{folder}/{file}"
                package.add(record(key, url, text.encode(), digest, refers))
        if package is not None:
            yield closed()

    return stored(rows.mapInArrow(run, "file string, records long"), "packages-manifest")


def splits(manifest: DataFrame) -> DataFrame:
    """Byte ranges of neighbouring records, from each package's directory and index."""
    with_workers(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = opened(file)
                with system.open_input_file(path) as source:
                    members = directory(source)
                    begin, _, method = members[ARCHIVE]
                    if method != zipfile.ZIP_STORED:
                        raise ValueError(f"{ARCHIVE} is not stored")
                    at, size, _ = members[INDEX]
                    ranges: list[list[int]] = []
                    for line in source.read_at(size, at).splitlines():
                        entry = json.loads(line)
                        if not ranges or ranges[-1][1] >= SPLIT_BYTES:
                            ranges.append([begin + entry["offset"], 0])
                        ranges[-1][1] += entry["length"]
                    if ranges:
                        starts, lengths = zip(*ranges)
                        yield pa.RecordBatch.from_pydict({"file": [file] * len(ranges), "start": pa.array(starts, pa.int64()),
                                                          "length": pa.array(lengths, pa.int64())})

    spread = manifest.select("file").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "file string, start long, length long")


RECORD = "key long, url string, record_type string, refers_to long, told_digest string, payload_bytes long, payload_digest string"


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the packages. Sizes and digests are those of the bytes read; revisits have none of their own."""
    schema = RECORD + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = opened(file)
                with system.open_input_file(path) as source:
                    raw, out = source.read_at(length, start), []
                while raw:
                    unpack = zlib.decompressobj(31)
                    found = parse_record(unpack.decompress(raw))
                    raw, payload = unpack.unused_data, found["payload"]
                    found["payload_bytes"] = None if payload is None else len(payload)
                    found["payload_digest"] = None if payload is None else hashlib.sha256(payload).hexdigest()
                    out.append(found)
                columns = [part.split()[0] for part in schema.split(", ")]
                kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                arrays = [pa.array([r[c] for r in out], kinds[part.split()[1]]) for c, part in zip(columns, schema.split(", "))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    ranges = splits(manifest)
    spread = ranges.repartition(partitions(manifest.sparkSession), "file", "start")
    return spread.mapInArrow(run, schema)


def resolved(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Records in which revisits have the size and digest of the payload they refer to."""
    full = (records.where("record_type = 'response' and key is not null").select(F.col("key").alias("target"),
            F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).dropDuplicates(["target", "full_digest"]))
    joined = records.join(full, (F.col("refers_to") == F.col("target")) & (F.col("told_digest") == F.col("full_digest")), "left")
    return joined.select(F.col("key").alias(key), F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
                         F.coalesce("payload_digest", "full_digest").alias("payload_digest"), "record_type", "refers_to")
