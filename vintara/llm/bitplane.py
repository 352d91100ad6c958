"""Token ids in files of shuffled planes, with a chunk index.

Rows are dealt by key range and sorted, so file after file holds ascending keys. In a file, ids are grouped
into blocks of ``BLOCK`` ids. A block is transposed into byte planes (all lowest bytes, then the next, ...) or bit
planes, and each plane is compressed with zstandard on its own: high planes are nearly constant and cost almost nothing. The
end of the file holds the chunk index (where each block starts, its ids, its plane sizes) and the key and length of each
document, so that a reader fetches only the blocks it needs.

File: magic, planes of block 0, 1, ..., index, 8-byte offset of the index, magic. A task writes its file under a name of its own
and reports it in the manifest; a file of a failed attempt is in no manifest. Null keys come first and stay null; repeated keys
stay, in no promised order among themselves; null texts are empty and hold the end id only. An empty table gives no file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm import bpe
from vintara.llm.common import large_lots, opened, output_folder, partitions, stored, text_rows, with_workers

MAGIC = b"VTPLANE1"
BLOCK = 65_536
#: Blocks a writer or reader holds at a time.
HELD = 8
#: Bytes of a worker's table of pieces.
UNIT_BYTES = 64 << 20
#: Pieces that reach the library as one string.
TOGETHER = 8_192
WHITE = re.compile(r"\s").search
MANIFEST = "file string, place int, docs long, ids long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit integers, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    if len(planes) == 4:
        octets = np.empty((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    else:
        flat = np.empty((count, 32), np.uint8)
        for k, plane in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=count)
        octets = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; ids arrive document by document."""

    def __init__(self, out, bits: bool = False, level: int = 3):
        self.out, self.bits, self.pack = out, bits, zstandard.ZstdCompressor(level=level)
        self.held, self.waiting, self.offset = [], 0, len(MAGIC)
        self.blocks: list[list] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.add_all([key], np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))

    def add_all(self, keys: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Several documents, whose ids stand in sequence."""
        self.keys += keys
        self.counts += counts.tolist()
        self.held.append(ids.astype("<u4").tobytes())
        self.waiting += len(ids)
        if self.waiting >= HELD * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for start in range(0, end, BLOCK):
            block = ids[start : start + BLOCK]
            planes = [self.pack.compress(p) for p in to_planes(block, self.bits)]
            self.blocks.append([self.offset, len(block), *map(len, planes)])
            for plane in planes:
                self.out.write(plane)
                self.offset += len(plane)
        self.held, self.waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        index = json.dumps({"bits": self.bits, "blocks": self.blocks, "docs": len(self.keys)}).encode()
        body = struct.pack("<I", len(index)) + index + known.tobytes() + keys.tobytes() + np.array(self.counts, "<i8").tobytes()
        self.out.write(self.pack.compress(body))
        self.out.write(struct.pack("<Q", self.offset) + MAGIC)


class PlaneReader:
    """Reads the index of a file, then single blocks by range."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or cut off")
        (at,) = struct.unpack("<Q", tail[:8])
        body = self.unpack.decompress(source.read_at(size - 16 - at, at))
        (length,) = struct.unpack("<I", body[:4])
        index = json.loads(body[4 : 4 + length])
        self.blocks, docs, at = index["blocks"], index["docs"], 4 + length
        known = np.frombuffer(body, np.uint8, docs, at)
        keys = np.frombuffer(body, "<i8", docs, at + docs)
        self.keys = [int(k) if known[i] else None for i, k in enumerate(keys)]
        self.counts = np.frombuffer(body, "<i8", docs, at + 9 * docs)

    def block(self, number: int) -> np.ndarray:
        at, count, *sizes = self.blocks[number]
        raw, planes = self.source.read_at(sum(sizes), at), []
        for size in sizes:
            planes.append(self.unpack.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, count)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, ids before it in this file, and ids of each document; holds the blocks of one document."""
        number, rest, start = 0, np.empty(0, "<u4"), 0
        for key, count in zip(self.keys, self.counts.tolist()):
            parts, have = [rest], len(rest)
            while have < count:
                parts.append(self.block(number))
                have += len(parts[-1])
                number += 1
            whole = np.concatenate(parts) if len(parts) > 1 else rest
            yield key, start, whole[:count]
            rest, start = whole[count:], start + count


#: Kinds of bytes: letters, other visible ASCII characters, ends of other characters that are no white space, white space but the space, spaces.
LETTER, MARK, SEEN, LINE, SPACE = 1, 2, 4, 8, 16
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = MARK
KINDS[65:91] = KINDS[97:123] = LETTER
KINDS[9:14] = LINE
KINDS[32] = SPACE


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of texts in UTF-8; 0 is any that no cut may rely on, as U+1680 and U+2000 are white space too."""
    found = KINDS[data]
    lead = np.flatnonzero(data > 0xC2)
    if len(lead):
        first, second = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
        found[lead[(first < 0xE0)] + 1] = SEEN
        found[lead[(first == 0xC3) & (second != 0x97) & (second != 0xB7)] + 1] = LETTER
        found[lead[((first > 0xE3) & (first < 0xF0)) | ((first == 0xE3) & (second > 0x80)) | ((first == 0xE2) & (second > 0x81))] + 2] = SEEN
        found[lead[first > 0xEF] + 3] = SEEN
    return found


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the bytes of texts, which begin at ``starts``, may be cut so that each part is split and encoded as within its text.

    The split pattern always ends a match between a character and white space after it, between a letter and a visible character that is no
    letter, and after a single line break. Other places stay uncut, in long runs of white space above all.
    """
    cut = np.zeros(len(data), bool)
    if len(data):
        kind = kinds(data)
        seen = (kind & (LETTER | MARK | SEEN)) != 0
        cut[1:] = (kind[1:] >= LINE) & seen[:-1]
        cut[2:] |= cut[1:-1] & (kind[1:-1] == LINE) & ((kind[2:] & (LETTER | MARK)) != 0)
        cut[1:] |= (kind[:-1] == LETTER) & (kind[1:] == MARK)
        cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class LibraryVocabulary(bpe.UnitTable):
    """Ids from the tokenizers library; repeated pieces come from the worker's table.

    Many texts are cut at once, in their bytes, and each distinct piece is looked up once. New pieces are handed to the library as strings of
    many, those without white space after a line break each. Its tokens cover a string byte by byte, so a piece's ids lie between
    the tokens that end with the piece before it and with itself; a piece without such ends is encoded alone.
    """

    def prepare(self, path: str, content: dict) -> None:
        super().prepare(path, content)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()

    def table_bytes(self) -> int:
        return UNIT_BYTES

    def coded(self, texts: list[str]) -> Iterator[bytes]:
        return (np.array(c.ids, np.int32).tobytes() for c in self.library.encode_batch_fast(texts, add_special_tokens=False))

    def learn(self, units: list[str]) -> dict[str, bytes]:
        loose = [u for u in units if bpe.OTHER(u)]
        rows = list(set(units).difference(loose))
        alone = [u for u in loose if WHITE(u)]
        for unit in set(loose).difference(alone):
            rows += "\n", unit
        found: dict[str, bytes] = {}
        for at in range(0, len(rows), TOGETHER):
            found |= self._side_by_side(rows[at : at + TOGETHER], alone)
        return found | dict(zip(alone, self.coded(alone)))

    def _side_by_side(self, words: list[str], alone: list[str]) -> dict[str, bytes]:
        """The ids of words that the library gets as one string; words whose ids are not to be told apart go to ``alone``."""
        (joined,) = self.coded(["".join(words)])
        stops = np.cumsum(self.spans[np.frombuffer(joined, np.int32)])
        ends = np.frombuffer(pa.array(words, pa.large_string()).buffers()[1], np.int64)[: len(words) + 1]
        last = np.searchsorted(stops, ends[1:])
        met = stops[np.minimum(last, len(stops) - 1)] == ends[1:] if len(stops) else np.zeros(len(words), bool)
        cuts = [0, *(4 * (last + 1)).tolist()]
        found = dict(zip(words, [joined[i:j] for i, j in zip(cuts, cuts[1:])]))
        for unsound in np.flatnonzero(~(met & np.append(True, met[:-1]))).tolist():
            alone.append(words[unsound])
            found.pop(words[unsound], None)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode_all(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in sequence, and how many each text has."""
        texts = texts.cast(pa.large_string())
        apart = np.zeros(len(texts), bool)
        for token in self.special:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._encode_plain(texts)
        ids, counts = self._encode_plain(pc.if_else(pa.array(apart), pa.scalar("", pa.large_string()), texts))
        coded = super().encode(texts.filter(pa.array(apart)).to_pylist())
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[apart], sizes), np.frombuffer(b"".join(coded), np.int32))
        counts[apart] = sizes
        return ids, counts

    def _encode_plain(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        if not size:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        part, bounds = data.slice(base, size), bounds - base
        starts = piece_starts(np.frombuffer(part, np.uint8), bounds[:-1])
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size)), part).dictionary_encode()
        coded = self._looked_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        which = pieces.indices.to_numpy()
        begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[which]
        sizes = sizes[which]
        ends = np.cumsum(sizes, dtype=np.int64)
        begin -= ends - sizes
        at = np.repeat(begin, sizes)
        at += np.arange(len(at))
        before = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        return np.frombuffer(b"".join(coded), np.int32)[at], np.diff(before)

    def _looked_up(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the table or else from the library."""
        coded = list(map(self.units.ids.get, distinct))
        missing = [i for i, ids in enumerate(coded) if ids is None]
        new = self.units.unknown({distinct[i] for i in missing})
        self.units.add(self.learn(new))
        for i in missing:
            coded[i] = self.units.ids[distinct[i]]
        self.units.drop(4 * bpe.SHORT, new)
        return coded


#: Texts that a task encodes together, in bytes.
LOT = 16 << 20


@lru_cache(maxsize=4)
def library_vocabulary(path: str) -> LibraryVocabulary:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryVocabulary(path)


def write(frame: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2, bits: bool = False,
          files: int | None = None) -> DataFrame:
    """Encode whole texts, append the end id and write plane files in ascending key order; returns the manifest."""
    spark = frame.sparkSession
    with_workers(spark)
    folder = output_folder(spark, "planes")
    rows = text_rows(frame, key, text).withColumn("key", F.col("key").cast("long"))
    dealt = rows.repartitionByRange(files or partitions(spark), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place, writer, stream = library_vocabulary(path), TaskContext.get().partitionId(), None, None
        for held in large_lots(batches, LOT):
            lot = pa.Table.from_batches(held).combine_chunks()
            if writer is None:
                system, root = opened(folder)
                system.create_dir(root, recursive=True)
                name = f"part-{place:05d}-{uuid.uuid4().hex}.planes"
                stream = system.open_output_stream(f"{root}/{name}")
                writer = PlaneWriter(stream, bits)
            ids, counts = words.encode_all(lot.column(1).chunk(0))
            writer.add_all(lot.column(0).to_pylist(), np.insert(ids, np.cumsum(counts), end), counts + 1)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "place": pa.array([place], pa.int32()),
                                              "docs": [len(writer.keys)], "ids": [sum(writer.counts)]})

    return stored(dealt.mapInArrow(run, MANIFEST), "planes-manifest")


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the files: key, start (ids before it in all files), n_tokens, and the ids as little-endian bytes.

    The manifest has one row for each file, so the running sum over it is small; files are read one per task.
    """
    spark = manifest.sparkSession
    with_workers(spark)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("file", "place", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    dealt = based.repartition(partitions(spark), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = opened(row["file"])
                with system.open_input_file(name) as source:
                    out, size = [], 0
                    for one, start, ids in PlaneReader(source).documents():
                        out.append((one, row["base"] + start, len(ids), ids.tobytes()))
                        size += len(ids)
                        if size >= 4 * BLOCK:
                            yield _batch(out, key)
                            out, size = [], 0
                    if out:
                        yield _batch(out, key)

    return dealt.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_le binary")


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "start", "n_tokens", "ids_le"])
