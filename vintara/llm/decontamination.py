"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Items are cut into parts of at most ``PART`` words; parts are what the index holds. Postings carry BM25 impacts divided by the part's own score, so a
passage that holds the whole part scores 1. Documents are cut into passages of ``PASSAGE`` words, each half over the next, so
every part lies whole in some passage. All parts at or above ``LEAST_SCORE`` are retrieved: passages whose terms cannot reach it are left out by
their summed term bounds and by what the rarest terms of each part give (the others cannot make up for them), and the rest walk the postings with pivots, skipping blocks whose maxima cannot reach it.

A hit is verified on the whole document: the share of the item's question (all but its last sentence) and of its answer (the last sentence; in an item
of one sentence, its last third) whose runs of ``WIDTH`` words occur in the document. Both have to reach their share.

The index is built in Spark, with document frequencies over all items. Postings name their item by a digest; texts stand once per item in a table of their
own. Parts are dealt to shards by running sums of their bytes, so the postings and texts of a shard take about ``SHARD_CHARS`` bytes and two
texts more at most. A task builds the index of each shard; the driver hands them on one by one, and a larger
benchmark is searched shard after shard. Null and empty texts and items give nothing; repeated items count once, repeated documents once
per key and item. The result has one row for each document and item that overlap.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import lots, sha256, stored, text_rows, with_workers
from vintara.operators.ordering import prefix_sums

PART, PASSAGE, WIDTH = 64, 128, 5
LEAST_SCORE, QUESTION, ANSWER = 0.6, 0.6, 0.5
#: Share of a part's score that its rarest terms make up; less than the least score is left to the others.
LEADING = 0.7
K1, B = 1.2, 0.75
BLOCK = 64
SHARD_CHARS = 64_000_000
#: Bytes of a posting besides its term, and postings of a batch.
POSTING, POSTINGS = 40, 50_000
REMEMBERED = 300_000
_PLAIN = re.compile(r"\w+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def plain(word: str) -> str:
    """Letters and digits of a lower-cased word."""
    return "".join(_PLAIN.findall(word))


def words_of(text: str) -> list[str]:
    return [w for w in map(plain, text.lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    sentences = [w for w in map(words_of, _SENTENCES.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def runs(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


class Index:
    """Postings of one shard: terms, normalised impacts, and block maxima."""

    def __init__(self, rows: list[tuple], parts: int, mean_length: float):
        """Rows: part number, item text number, term, count, document frequency, part length."""
        self.terms = {t: n for n, t in enumerate(sorted({r[2] for r in rows}))}
        part = np.array([r[0] for r in rows], np.int64)
        term = np.array([self.terms[r[2]] for r in rows], np.int64)
        count, frequency, length = (np.array([r[k] for r in rows], float) for k in (3, 4, 5))
        weight = np.log1p((parts - frequency + 0.5) / (frequency + 0.5))
        impact = weight * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean_length))
        impact /= np.bincount(part, impact)[part]
        order = np.lexsort((part, term))
        self.part, self.impact, term = part[order], impact[order], term[order]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(self.impact, self.start[:-1]) if len(rows) else np.empty(0)
        self.blocks = [[float(self.impact[i : min(i + BLOCK, b)].max()) for i in range(a, b, BLOCK)] for a, b in zip(self.start[:-1].tolist(), self.start[1:].tolist())]
        self.item = {int(r[0]): r[1] for r in rows}
        self._leading(term, frequency[order])

    def _leading(self, term: np.ndarray, frequency: np.ndarray) -> None:
        """The rarest postings of each part, up to ``LEADING`` of its score, and what they must reach for the rest to suffice."""
        by_part = np.lexsort((frequency, self.part))
        part, impact = self.part[by_part], self.impact[by_part]
        first = np.searchsorted(part, part)
        total = np.cumsum(impact)
        before = total - impact - (total[first] - impact[first])
        leads = before < LEADING
        count = int(self.part.max()) + 1
        self.needed = LEAST_SCORE - np.bincount(part, np.where(leads, 0.0, impact), minlength=count)
        kept = np.sort(by_part[leads])  # in order of term again
        self.lead_part, self.lead_impact = self.part[kept], self.impact[kept]
        self.lead_start = np.searchsorted(term[kept], np.arange(len(self.terms) + 1))

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All parts whose score over these distinct terms is at least ``least``, by block-max WAND."""
        part, impact, start, bound, blocks = self.part, self.impact, self.start, self.bound, self.blocks
        at = {t: int(start[t]) for t in terms}
        live, out = sorted(terms, key=lambda t: part[at[t]]), []

        def skip(t: int, target: int) -> None:
            at[t] += int(np.searchsorted(part[at[t] : start[t + 1]], target))

        while live:
            total, pivot = 0.0, -1
            for n, t in enumerate(live):
                total += bound[t]
                if total >= least:
                    pivot = n
                    break
            if pivot < 0:
                break
            goal = int(part[at[live[pivot]]])
            while pivot + 1 < len(live) and part[at[live[pivot + 1]]] == goal:
                pivot += 1
            ahead = live[: pivot + 1]
            upper, border = 0.0, None
            for t in ahead:
                here = at[t] + int(np.searchsorted(part[at[t] : start[t + 1]], goal))
                if here >= start[t + 1]:
                    continue
                block = (here - int(start[t])) // BLOCK
                upper += blocks[t][block]
                last = int(part[min(int(start[t]) + (block + 1) * BLOCK, int(start[t + 1])) - 1])
                border = last if border is None else min(border, last)
            if upper >= least:
                if part[at[live[0]]] == goal:
                    score = sum(float(impact[at[t]]) for t in ahead)
                    if score >= least:
                        out.append((goal, score))
                    for t in ahead:
                        at[t] += 1
                else:
                    for t in ahead:
                        skip(t, goal)
            else:
                following = part[at[live[pivot + 1]]] if pivot + 1 < len(live) else None
                target = max(goal, border if border is not None else goal) + 1
                if following is not None:
                    target = min(target, max(int(following), goal + 1))
                for t in ahead:
                    skip(t, target)
            live = sorted((t for t in live if at[t] < start[t + 1]), key=lambda t: part[at[t]])
        return out


class Terms(dict):
    """Numbers of words as written, -1 for words that no item has."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        self[word] = value = self.terms.get(plain(word), -1)
        return value


def _candidates(index: Index, numbers: list[np.ndarray]) -> Iterator[tuple[int, list[int]]]:
    """Document and distinct terms of each passage whose term bounds reach the least score."""
    half = PASSAGE // 2
    where, term, count = [], [], 0
    owner: list[np.ndarray] = []
    for doc, ids in enumerate(numbers):
        passages = max(1, -(-len(ids) // half) - 1)
        known = np.flatnonzero(ids >= 0)
        last = np.minimum(known // half, passages - 1)
        first = np.maximum(known // half - 1, 0)
        where += [count + first, (count + last)[first != last]]
        term += [ids[known], ids[known][first != last]]
        owner.append(np.full(passages, doc))
        count += passages
    pairs = np.unique(np.concatenate(where) * len(index.terms) + np.concatenate(term))
    passage, term_of = np.divmod(pairs, len(index.terms))
    reach = np.bincount(passage, index.bound[term_of], minlength=count)
    owners = np.concatenate(owner)
    edges = np.searchsorted(passage, np.arange(count + 1))
    # What the leading postings give to each part that a passage touches.
    begin = index.lead_start[term_of]
    many = index.lead_start[term_of + 1] - begin
    at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    parts = len(index.needed)
    touched, place = np.unique(np.repeat(passage, many) * parts + index.lead_part[at], return_inverse=True)
    led = np.bincount(place, index.lead_impact[at], minlength=len(touched))
    able = np.zeros(count, bool)
    able[touched[led >= index.needed[touched % parts] - 1e-9] // parts] = True
    for p in np.flatnonzero(able & (reach >= LEAST_SCORE - 1e-9)).tolist():
        yield int(owners[p]), term_of[edges[p] : edges[p + 1]].tolist()


def named(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct items (item, digest, text); the digest is of the key and the text."""
    rows = text_rows(items, item, text).select(F.col("key").cast("long").alias("item"), "text").dropDuplicates()
    return rows.select("item", F.md5(F.concat(F.coalesce(F.col("item").cast("string"), F.lit("")), F.lit(" "), "text").cast("binary")).alias("digest"), "text")


def postings(items: DataFrame) -> DataFrame:
    """Rows (digest, number, term, count, length) of the parts of named items, in batches of bounded size."""
    with_workers(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["digest", "number", "term", "count", "length"])

        out: list[tuple] = []
        for batch in batches:
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(content)
                for number, begin in enumerate(range(0, len(words), PART)):
                    part = words[begin : begin + PART]
                    out += [(digest, number, term, part.count(term), len(part)) for term in dict.fromkeys(part)]
                    if len(out) >= POSTINGS:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return items.select("digest", "text").mapInArrow(run, "digest string, number int, term string, count int, length int")


def placed(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Parts (digest, number, length, shard), dealt by running sums of the bytes of their postings; the text counts with the first part."""
    sizes = texts.select("digest", F.octet_length("text").cast("long").alias("size"))
    parts = found.groupBy("digest", "number").agg(F.max("length").alias("length"), F.sum(F.octet_length("term") + POSTING).alias("bytes")).join(sizes, "digest")
    parts = parts.withColumn("bytes", F.col("bytes") + F.when(F.col("number") == 0, F.col("size")).otherwise(0))
    summed = prefix_sums(parts, [], ["digest", "number"], upto=F.col("bytes"))
    return summed.select("digest", "number", "length", F.floor((F.col("upto") - F.col("bytes")) / SHARD_CHARS).cast("int").alias("shard"))


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (key, item, score, question, answer): every document and item that overlap."""
    rows = text_rows(docs, key, text).withColumn("key", F.col("key").cast("long"))
    return _overlaps(rows, items, item, item_text).withColumnRenamed("_key", key)


def _overlaps(rows: DataFrame, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """``overlaps`` for rows (key, text) with keys of any type, which come back as ``_key``."""
    spark = rows.sparkSession
    with_workers(spark)
    texts = stored(named(items, item, item_text), "items")
    found = stored(postings(texts), "postings")
    parts = stored(placed(found, texts), "parts")
    count, mean = parts.agg(F.count("*"), F.avg("length")).first()
    schema = f"_key {rows.schema['key'].dataType.simpleString()}, `{item}` long, score double, question double, answer double"
    if not count:
        return spark.createDataFrame([], schema)
    frequency = found.groupBy("term").agg(F.count("*").alias("frequency"))
    joined = found.join(parts.select("digest", "number", "shard"), ["digest", "number"]).join(frequency, "term")
    held = parts.select(F.col("shard").alias("at"), F.col("digest").alias("whole")).distinct().join(texts, F.col("whole") == F.col("digest"))
    built = joined.select("shard", "digest", "number", "term", "count", "frequency", "length").groupBy("shard").cogroup(
        held.select("at", "whole", "item", "text").groupBy("at")).applyInArrow(_builder(int(count), float(mean)), "shard int, index binary")
    indexes = stored(built, "indexes")
    hits = None
    for shard in sorted(r["shard"] for r in indexes.select("shard").collect()):
        sent = spark.sparkContext.broadcast(bytes(indexes.where(F.col("shard") == shard).first()["index"]))  # a shard at once
        some = rows.mapInArrow(_searcher(sent, ("_key", item)), schema)
        hits = some if hits is None else hits.unionAll(some)
    return hits.groupBy("_key", item).agg(*[F.max(c).alias(c) for c in ("score", "question", "answer")])


def _builder(count: int, mean: float):
    """The index of a shard with the items of its texts, from the postings and texts of the shard."""

    def run(rows: pa.Table, texts: pa.Table) -> pa.Table:
        place = {d: n for n, d in enumerate(texts.column("whole").to_pylist())}
        columns = [rows.column(c).to_pylist() for c in ("digest", "number", "term", "count", "frequency", "length")]
        numbers = {p: n for n, p in enumerate(dict.fromkeys(zip(*columns[:2])))}
        index = Index([(numbers[r[:2]], place[r[0]], *r[2:]) for r in zip(*columns)], count, mean)
        contents = list(zip(texts.column("item").to_pylist(), texts.column("text").to_pylist()))
        return pa.table({"shard": pa.array(rows.column("shard")[:1].to_pylist(), pa.int32()), "index": pa.array([pickle.dumps((index, contents))], pa.binary())})

    return run


def _searcher(sent, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, contents = pickle.loads(sent.value)
        known = Terms(index.terms)
        checks: dict[int, tuple[set, set]] = {}
        for batch in (lot for whole in batches for lot in lots(whole, 1, 4_000_000)):
            if len(known) > REMEMBERED:
                known.clear()
            texts = batch.column(1).to_pylist()
            numbers = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in (t.lower().split() for t in texts)]
            scores: dict[tuple[int, int], float] = {}
            for doc, terms in _candidates(index, numbers):
                for part, score in index.search(terms, LEAST_SCORE - 1e-9):
                    pair = doc, index.item[part]
                    scores[pair] = max(score, scores.get(pair, 0.0))
            out, last, inside = [], None, set()
            for (doc, number), score in sorted(scores.items()):
                if doc != last:
                    last, inside = doc, runs(words_of(texts[doc]))
                if number not in checks:
                    question, answer = question_and_answer(contents[number][1])
                    checks[number] = runs(question), runs(answer)
                shares = [_share(part, inside, texts[doc]) for part in checks[number]]
                if shares[0] >= QUESTION and shares[1] >= ANSWER:
                    out.append((batch.column(0)[doc].as_py(), contents[number][0], score, *shares))
            if out:
                kinds = (batch.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*names, "score", "question", "answer"])

    return run


def _share(wanted: set[tuple[str, ...]], inside: set[tuple[str, ...]], text: str) -> float:
    """Share of runs found; runs shorter than the width are looked up in the running words."""
    if not wanted:
        return 1.0
    if all(len(run) == WIDTH for run in wanted):
        return len(wanted & inside) / len(wanted)
    running = " " + " ".join(words_of(text)) + " "
    return sum(f" {' '.join(run)} " in running for run in wanted) / len(wanted)


def without_overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that overlap no item, with all their columns.

    Rows go by their text, whatever their key: one with a null key that overlaps an item goes, and of rows that share a key only those whose
    own text overlaps.
    """
    digest = sha256(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(digest.alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hit = _overlaps(rows, items, item, item_text).select(F.col("_key").alias("_hit")).distinct()
    return docs.join(hit, digest == F.col("_hit"), "left_anti")
