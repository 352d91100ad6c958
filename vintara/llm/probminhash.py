"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is a weighted set: its runs of ``WIDTH`` lower-cased words, weighted by how often they occur; a shorter text is one run. Every
run sends a Poisson process of arrivals whose rate is its weight, each arrival at a register given by the run's hash, and a
register keeps the run that arrived first. Arrivals come in order of time, so a run stops as soon as it is later than all
registers of its text. Two texts agree on a register with the probability Jaccard similarity of their weighted sets.

Registers form bands; texts that agree on a band share a bucket. Texts that buckets connect form a group, and inside groups texts are compared by the
exact similarity, except those already joined and those whose common runs bound it below the least similarity. Large groups
are cut into chunks and each pair of chunks is compared in one task, which returns the links that join its texts and no pairs. Exact copies are one row throughout.

Null texts are empty; texts without words are near copies only of equal texts. A class is one of texts: rows that share a key but not their text have the
class of their own text, and rows with a null key that of their text, whose id is null if no row of it has a key. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm import buckets
from vintara.llm.common import lots, partitions, stored, text_rows, with_each, with_workers

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Docs of a chunk.
CHUNK = 256
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def weighted_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of a text in order of hash, and their weights."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0)
    width = min(WIDTH, len(words))
    runs = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        runs += mixed(words[j : len(words) - width + 1 + j] + _FACTORS[j]) * _FACTORS[j]
    runs, counts = np.unique(mixed(runs), return_counts=True)
    return runs, counts.astype(float)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets, exactly."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # Per common run d: sum over all runs of max(wa(e) / wa(d), wb(e) / wb(d)); runs of one side count on that side.
    order = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    ratio = wa / wb
    above = np.concatenate([np.cumsum(wa[::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(wb)])
    at = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / ((above[at] + only_a) / wa + (below[at] + only_b) / wb)).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers of many weighted sets: a row each; sets without runs keep zeros."""
    count = len(sets)
    doc = np.repeat(np.arange(count), [len(s[0]) for s in sets])
    run = np.concatenate([s[0] for s in sets]) if count else np.empty(0, np.uint64)
    rate = np.concatenate([s[1] for s in sets]) if count else np.empty(0)
    first = np.full(count * REGISTERS, np.inf)
    kept = np.zeros(count * REGISTERS, np.uint64)
    time, turn = np.zeros(len(run)), 0
    while len(run):
        turn += 1
        draw = mixed(run + _U(turn * 2 * 0x9E3779B97F4A7C15 % 2**64))
        time += -np.log(((draw >> _U(11)).astype(float) + 0.5) / 2.0**53) / rate
        place = doc * REGISTERS + (mixed(draw ^ _U(0xD1B54A32D192ED03)) % _U(REGISTERS)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        kept[place[won]] = run[won]
        latest = first.reshape(count, REGISTERS).max(axis=1)
        live = time < latest[doc]
        doc, run, rate, time = doc[live], run[live], rate[live], time[live]
    return kept.reshape(count, REGISTERS)


def band_keys(kept: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(kept), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * _FACTORS[0] + kept.reshape(len(kept), BANDS, ROWS)[:, :, r] + _FACTORS[r])
    return mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTORS[1]).view(np.int64)


def sketches(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, digest of the whole text, and its band keys (none for a text without words)."""
    with_workers(frame.sparkSession)
    rows = text_rows(frame, key, text).select(F.col("key").cast("long").alias("key"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (lot for whole in batches for lot in lots(whole, 1, 4_000_000)):
            sets = [weighted_runs(hashes.of(t)) for t in batch.column(1).to_pylist()]
            keys = band_keys(signatures(sets))
            bands = [k.tolist() if len(s[0]) else [] for k, s in zip(keys, sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bands, pa.list_(pa.int64()))], names=["key", "digest", "bands"])

    return rows.mapInArrow(run, "key long, digest string, bands array<long>")


class Bounds:
    """Upper bounds of the similarities of one of several weighted sets to all of them.

    A common run d adds 1 / sum over e of max(a(e) / a(d), b(e) / b(d)) to the similarity, at most min(a(d) / A, b(d) / B) with the total weights A and B.
    """

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.runs, self.shares = [s[0] for s in sets], [s[1] / s[1].sum() if len(s[1]) else s[1] for s in sets]
        runs = np.concatenate(self.runs)
        order = np.argsort(runs, kind="stable")
        self.ordered, self.share = runs[order], np.concatenate(self.shares)[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])[order]

    def of(self, i: int) -> np.ndarray:
        low, high = (np.searchsorted(self.ordered, self.runs[i], side) for side in ("left", "right"))
        sizes = high - low
        at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        least = np.minimum(self.share[at], np.repeat(self.shares[i], sizes))
        return np.bincount(self.owner[at], least, len(self.runs))


def links_within(rows: list[tuple[int, int, str]], hashes: WordHashes) -> list[tuple[int, int]]:
    """Links among rows (side, key, text) that join all rows linked by the exact similarity.

    Rows of side 0 are compared with each other if there is no side 1, else with those of side 1. Rows already joined need no
    comparison, nor do those whose bound is below the least similarity.
    """
    sets = [weighted_runs(hashes.of(text)) for _, _, text in rows]
    root = np.arange(len(rows))
    other = np.array([side for side, _, _ in rows], bool)
    split = bool(other.any())
    bounds = Bounds(sets)
    out = []
    for i in range(len(rows)):
        if split and other[i]:
            continue
        rest = np.flatnonzero(other if split else np.arange(len(rows)) > i)
        rest = rest[root[rest] != root[i]]
        if len(rest):
            rest = rest[bounds.of(i)[rest] >= SIMILAR - 1e-9]
        for j in rest.tolist():
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= SIMILAR:
                root[root == root[j]] = root[i]
                out.append((rows[i][1], rows[j][1]))
    return out


def linked(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the docs of each group. ``groups`` has group, doc and place, its position in the group; ``texts`` has key and text.

    A group is cut into chunks of ``CHUNK`` docs, and each pair of chunks is compared by one task, so large groups spread and only links leave a task.
    """
    sizes = groups.groupBy(F.col("group").alias("g")).agg(F.max("place").alias("last"))
    placed = groups.join(sizes, F.col("group") == F.col("g")).withColumn("mine", F.floor(F.col("place") / CHUNK).cast("int"))
    others = F.sequence(F.lit(0), F.floor(F.col("last") / CHUNK).cast("int"))
    spread = placed.join(texts, F.col("doc") == F.col("key")).select("group", "doc", "text", "mine", F.explode(others).alias("other"))
    cell = spread.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "doc", "text")
    dealt = cell.repartition(partitions(groups.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, current = WordHashes(), [], None

        def out() -> pa.RecordBatch:
            found = links_within(held, hashes)
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for batch in batches:
            for group, i, j, side, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, i, j) != current and held:
                    yield out()
                    held = []
                current = group, i, j
                held.append((side, doc, text))
        if held:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def classes(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the table: its key and ``class_id``, the smallest key of its class."""
    return _classes(frame, key, text).select(F.col("key").alias(key), "class_id")


def one_of_each(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with all its columns: that of the smallest key, null last, then of the smallest digest; one of equals."""
    found = _classes(frame, key, text)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("bare"), F.coalesce("key", F.lit(0)).alias("at"), "digest")).alias("first"))
    first = least.select(F.col("first.bare").alias("_bare"), F.col("first.at").alias("_at"), F.col("first.digest").alias("_digest"))
    own = F.col(f"`{key}`").cast("long")
    marked = frame.select("*", own.isNull().alias("_bare"), F.coalesce(own, F.lit(0)).alias("_at"),
                          F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("_digest"))
    where = ["_bare", "_at", "_digest"]
    return marked.join(first, where, "left_semi").dropDuplicates(where).drop(*where)


def _placed(groups: DataFrame) -> DataFrame:
    """A position for each doc of its group. Docs are dealt into cells by a hash first, so a large group is numbered by many tasks."""
    cells = groups.withColumn("cell", F.pmod(F.xxhash64("doc"), 64))
    sizes = cells.groupBy("group", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("group").alias("g"), F.col("cell").alias("c"), before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("group", "cell").orderBy("doc"))
    numbered = cells.withColumn("n", inside).join(starts, (F.col("group") == F.col("g")) & (F.col("cell") == F.col("c")))
    return numbered.select("group", "doc", (F.col("start") + F.col("n") - 1).alias("place"))


def _classes(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, digest of its text, ``root``, which is one number per class, and class_id."""
    sketched = stored(sketches(frame, key, text), "sketches")
    copies = sketched.groupBy("digest").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"))
    copies = stored(copies.select(F.monotonically_increasing_id().alias("doc"), "*"), "copies")
    banded = copies.select("doc", F.explode("bands").alias("bucket"))
    leads = banded.groupBy(F.col("bucket").alias("b")).agg(F.min("doc").alias("lead"), F.count("*").alias("n")).where("n > 1")
    near = stored(banded.join(leads, F.col("bucket") == F.col("b")).select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), "near")
    joined = buckets.components(near)
    groups = joined.select("root", "key").unionAll(joined.select("root", F.col("root").alias("key")).distinct())
    groups = stored(groups.select(F.col("root").alias("group"), F.col("key").alias("doc")), "groups")
    # The texts of grouped docs, each from one of the rows that hold it.
    wanted = groups.select("doc").join(copies.select("doc", "digest", "rep"), "doc")
    plain = text_rows(frame, key, text).select(F.col("key").cast("long").alias("own"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    bare = F.col("own").isNull() == F.col("rep").isNull()
    same = (F.coalesce("own", F.lit(0)) == F.coalesce("rep", F.lit(0))) & (plain["digest"] == wanted["digest"]) & bare
    texts = stored(plain.join(wanted, same).select(F.col("doc").alias("key"), "text").dropDuplicates(["key"]), "texts")
    roots = buckets.components(linked(_placed(groups), texts))
    named = copies.join(roots.select(F.col("key").alias("doc"), "root"), "doc", "left").select("doc", "digest", "rep", F.coalesce("root", "doc").alias("root"))
    ids = named.groupBy(F.col("root").alias("of")).agg(F.min("rep").alias("class_id"))
    named = named.join(ids, F.col("root") == F.col("of")).select("digest", "root", "class_id")
    return with_each(sketched.select("key", "digest"), stored(named, "named"), "digest")
