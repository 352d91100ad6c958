"""Byte-level BPE encoding and decoding over contiguous rank arrays.

A text is cut at single spaces into units (a space and the characters up to the next one). Units repeat, so each
worker keeps their ids in a table bounded by bytes. A unit that is not in the table is cut into pieces by the vocabulary's
split pattern, and the new pieces of a batch are merged together: one row per piece holds its part ids side by side
and one row the ranks of adjacent parts. Each step finds the smallest rank of every row (the leftmost on ties),
joins the two parts by deleting the boundary between them, and refreshes the ranks beside it, until no adjacent
pair is in the vocabulary. Pieces longer than ``SHORT`` bytes use a linked list and a heap, which gives the same merges in
n log n steps.

Null texts count as empty and give no ids. Every row gives one row; repeated rows stay. The special token's string
in a text becomes its id, as the tokenizer files define it. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import code_points, released, sha256, small_lots, text_lots, text_rows, with_workers

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHORT = 48
NONE = np.int32(2**31 - 1)
#: Bytes of a worker's table, and what an entry takes beside its characters and ids.
REMEMBERED, ENTRY = 16 << 20, 160


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Remembered:
    """Ids of strings. A full table becomes the older one, from which strings in use are taken over."""

    def __init__(self, limit: int):
        self.limit = limit
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def unknown(self, wanted: set[str]) -> list[str]:
        """Those that neither table holds; the others are in ``ids`` from here on."""
        if self.bytes > self.limit:
            self.older, self.ids, self.bytes = self.ids, {}, 0
        wanted = wanted.difference(self.ids)
        again = wanted.intersection(self.older)
        self.add(dict(zip(again, map(self.older.__getitem__, again))))
        return list(wanted.difference(again))

    def add(self, found: dict[str, bytes]) -> None:
        self.ids.update(found)
        self.bytes += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def drop(self, longer: int, among: list[str]) -> None:
        """Forget long strings: rarely met again, and not small."""
        for one in among:
            if len(one) > longer:
                self.bytes -= len(one) + len(self.ids.pop(one)) + ENTRY


class TokenBytes:
    """The bytes of each id of a tokenizer file, without its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        ids: dict[str, int] = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        to_byte = {c: b for b, c in letters.items()}
        token_bytes = {i: bytes(to_byte[c] for c in token) for token, i in ids.items() if token not in self.special}
        token_bytes |= {i: token.encode() for token, i in self.special.items()}
        in_order = [token_bytes.get(i, b"") for i in range(max(token_bytes) + 1)]
        self.spans = np.array([len(b) for b in in_order], np.int64)
        self.starts = np.cumsum(self.spans) - self.spans
        self.joined_bytes = np.frombuffer(b"".join(in_order), np.uint8)
        self.prepare(path, content)

    def prepare(self, path: str, content: dict) -> None:
        """What encoders take from the file besides."""

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind ids: each id's span of the joined token bytes, copied side by side."""
        inside = ids[(ids >= 0) & (ids < len(self.spans))]
        sizes = self.spans[inside]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[inside] - (ends - sizes), sizes)
        return self.joined_bytes[shift + np.arange(len(shift))].tobytes()


class UnitTable(TokenBytes):
    """Encodes texts by their units; ``learn`` gives the ids of new ones."""

    def prepare(self, path: str, content: dict) -> None:
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.units = Remembered(self.table_bytes())

    def table_bytes(self) -> int:
        return REMEMBERED

    def learn(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers in sequence."""
        plans = [self._units(text) for text in texts]
        new = self.units.unknown(set(chain.from_iterable(u for plan in plans for u in plan if isinstance(u, list))))
        self.units.add(dict(self.learn(new)))
        known = self.units.ids.__getitem__
        out = [b"".join(b"".join(map(known, u)) if isinstance(u, list) else u for u in plan) for plan in plans]
        self.units.drop(4 * SHORT, new)
        return out

    def _units(self, text: str) -> list:
        """Runs of units, and the ids of special tokens between them."""
        if self.cut and any(token in text for token in self.special):
            return [np.int32(self.special[p]).tobytes() if p in self.special else split_units(p) for p in self.cut.split(text) if p]
        return [split_units(text)]


class Vocabulary(UnitTable):
    """Merges of a tokenizer file over contiguous rank arrays."""

    def prepare(self, path: str, content: dict) -> None:
        super().prepare(path, content)
        ids, letters = content["model"]["vocab"], byte_letters()
        self.first = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.rank_of: dict[int, int] = {}
        joined = []
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank_of[(ids[left] << 32) | ids[right]] = rank
            joined.append(ids[left + right])
        self.joined = np.array(joined, np.int32)  # by rank
        keys = np.fromiter(self.rank_of, np.int64, len(self.rank_of))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(self.rank_of.values(), np.int32, len(keys))[order]
        self.pattern = regex.compile(PATTERN)
        self.pieces = Remembered(self.table_bytes())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Merge many short words at once; a row of the arrays is a word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for some in np.array_split(order, max(1, len(words) // 2048)):
            if not len(some):
                continue
            lengths, width = sizes[some].copy(), int(sizes[some].max())
            parts = np.full((len(some), width + 1), -1, np.int32)
            flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
            parts[:, :width][np.arange(width) < lengths[:, None]] = self.first[flat]
            ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
            columns, rows = np.arange(width + 1), np.arange(len(some))
            while len(rows):
                where = ranks[rows].argmin(axis=1)
                least = ranks[rows, where]
                live = least < NONE
                rows, where, least = rows[live], where[live], least[live]
                if not len(rows):
                    break
                old, held = parts[rows], ranks[rows]
                shift = columns[None, :] > where[:, None]
                moved = np.concatenate([old[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1)
                new = np.where(shift, moved, old)
                line = np.arange(len(rows))
                new[line, where] = self.joined[least]
                moved = np.concatenate([held[:, 1:], np.full((len(rows), 1), NONE, np.int32)], axis=1)
                fresh = np.where(shift[:, :-1], moved, held)
                fresh[line, where] = self.pair_ranks(new[line, where], new[line, where + 1])
                before = np.maximum(where - 1, 0)
                fresh[line, before] = np.where(where > 0, self.pair_ranks(new[line, before], new[line, before + 1]), fresh[line, before])
                parts[rows], ranks[rows] = new, fresh
                lengths[rows] -= 1
            for row, word in enumerate(some):
                out[word] = parts[row, : lengths[row]].tobytes()
        return out

    def merge_long(self, word: bytes) -> bytes:
        """Merge one long word with a heap over a linked list."""
        part = self.first[np.frombuffer(word, np.uint8)].tolist()
        size = len(part)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < size:
                a, b = part[i], part[after[i]]
                if (rank := self.rank_of.get((a << 32) | b)) is not None:
                    heapq.heappush(heap, (rank, i, a, b))

        for i in range(size - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= size or part[j] != b:
                continue
            part[i], part[j], after[i] = int(self.joined[rank]), -1, after[j]
            if after[j] < size:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([p for p in part if p >= 0], np.int32).tobytes()

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the split pattern does not cut further."""
        coded = [piece.encode() for piece in pieces]
        short = [i for i, raw in enumerate(coded) if len(raw) <= SHORT]
        out = [b"" if len(raw) <= SHORT else self.merge_long(raw) for raw in coded]
        for i, ids in zip(short, self.merge_short([coded[i] for i in short])):
            out[i] = ids
        return out

    def learn(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of new units. Units of one word are cut into pieces in one run of the pattern over all of them."""
        rest = [u for u in units if OTHER(u)]
        word = list(set(units).difference(rest))
        cut = [self.pattern.findall("".join(word)), *map(self.pattern.findall, rest)]
        new = self.pieces.unknown(set(chain.from_iterable(cut)))
        self.pieces.add(dict(zip(new, self.merge(new))))
        known = self.pieces.ids.__getitem__
        coded = list(map(known, cut[0]))
        ends = np.cumsum(np.fromiter(map(len, cut[0]), np.int64, len(cut[0])))
        stops = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        at = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, word), np.int64, len(word))))
        joined, begin = b"".join(coded), 0
        for unit, stop in zip(word, stops[at].tolist() if word else ()):
            yield unit, joined[begin:stop]
            begin = stop
        for unit, pieces in zip(rest, cut[1:]):
            yield unit, b"".join(map(known, pieces))
        self.pieces.drop(SHORT, new)


#: Anything but a space and one word, over whose ends no run of white space can reach.
OTHER = re.compile(r"\S\s|\A[^ ]|\s\s|\A \Z").search
_AMBIGUOUS = regex.compile(r"\s \s|\s $")


def split_units(text: str) -> list[str]:
    """Cut before single spaces. A cut is exact unless white space stands on both sides of the space.

    Such texts are cut only where a space lies between two characters that are not white space.
    """
    if not text:
        return []
    if _AMBIGUOUS.search(text):
        return [unit for unit in regex.split(r"(?<=\S)(?= \S)", text) if unit]
    first, *rest = text.split(" ")
    units = [" " + unit for unit in rest]
    return [first, *units] if first else units


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    released()
    words = Vocabulary(path)
    released()  # of the parsed file
    return words


@lru_cache(maxsize=4)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def id_lists(coded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _decoded(tokens: TokenBytes, keys: pa.Array, lists: pa.ListArray, sizes: np.ndarray, key: str) -> Iterator[pa.RecordBatch]:
    """Batches (key, ids, decoded) of bounded size; bytes that are no UTF-8 become replacement characters."""
    for a, b in small_lots(sizes, 500_000):
        some = lists.slice(a, b - a)
        ids, ends = some.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes[a:b]).tolist()
        texts = pa.array([tokens.decode(ids[i:j]).decode("utf-8", "replace") for i, j in zip([0, *ends], ends)], pa.string())
        yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), some, texts], names=[key, "ids", "decoded"])


def encode(frame: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key and ``ids``, the token ids of the whole text in order."""
    with_workers(frame.sparkSession)
    rows = text_rows(frame, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for keys, texts in text_lots(batch):
                yield pa.RecordBatch.from_arrays([keys, id_lists(words.encode(texts))], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def decode(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: the key, the ids and ``decoded``, the text they stand for; null ids decode as none."""
    with_workers(frame.sparkSession)
    rows = frame.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            yield from _decoded(tokens, batch.column(0), batch.column(1), sizes, key)

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(frame: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(frame))`` in one pass: a core holds one Python worker with one vocabulary."""
    with_workers(frame.sparkSession)
    rows = text_rows(frame, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for keys, texts in text_lots(batch):
                coded = words.encode(texts)
                yield from _decoded(words, keys, id_lists(coded), np.array([len(c) // 4 for c in coded], np.int64), key)

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(frame: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """Counts and digests of decoded rows, and the columns to keep."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return frame.select(key, *keep, F.size("ids").cast("long").alias("n_tokens"), sha256(joined).alias("ids_sha256"),
                        sha256(F.col("decoded")).alias("decoded_sha256"), code_points(F.col("decoded")).alias("decoded_chars"))
