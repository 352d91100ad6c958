"""Toxicity by compression distance: zstandard dictionaries and calibrated thresholds on window lengths.

Every lower-cased word is written as a code of fixed width, a hash of the word and one of its first ``STEM`` letters, so that a word costs the same
in a window whatever its length: little if the dictionary has the word, somewhat less than nothing known if it has the stem, the full code otherwise. A text is cut into
windows of ``WINDOW`` words. zstandard trains one dictionary on all windows of whole ordinary texts and one on those of toxic texts, which is used over
the first. Single words of toxic texts that ordinary texts do not have as often, a selected lexicon, make a third dictionary over the
first. A window has two gains: the lengths it saves with the toxic and with the lexicon dictionary instead of the ordinary one. A logistic model turns
both kinds of gains of a text (how many windows pass each threshold, the greatest, the sum, relative to the length) into a score; its weights
are the calibration.

Fitting uses a bounded sample of labelled rows outside the held-out fold, at most ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters of each label in the order of a
hash of the key, in one task; a part of it trains the dictionaries and the rest calibrates. Labels and keys serve to choose and weigh these rows only. Scoring reads every whole text.

Null texts are empty and score like any text without gains. Without labelled rows of both kinds every score is 0. Labels that repeat a key
count once (the smallest), null labels not at all; repeated documents are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import lots, remainder, stored, text_rows, with_workers

FOLDS = 5
STEM, WINDOW = 5, 8
CODE = 16
BASE_BYTES, OWN_BYTES = 64 << 10, 16 << 10
#: Training picks segments of so many bytes, half a window, so that sequences of words stay together.
SEGMENT, MER = CODE * WINDOW // 2, 8
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 10_000_000
#: A word of two toxic texts at least is in the lexicon if it is so much more often in toxic texts than in ordinary ones.
LIFT = 30.0
THRESHOLDS = (4, 9, 12, 18, 26)
REMEMBERED = 300_000
_LETTERS = re.compile(rb"[\w\x80-\xff]+")


class Codes(dict):
    """The code of each word, as written."""

    def __missing__(self, word: bytes) -> bytes:
        plain = b"".join(_LETTERS.findall(word)) or word
        stem = plain.decode("utf-8", "ignore")[:STEM].encode()
        self[word] = code = (hashlib.blake2b(plain, digest_size=CODE // 2).digest()
                             + hashlib.blake2b(stem, digest_size=CODE // 2, person=b"stem").digest())
        return code

    def of(self, text: str) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        return list(map(self.__getitem__, text.lower().encode().split()))


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; all of them where they are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def cut(words: list[bytes]) -> list[bytes]:
    """The windows of a coded text."""
    return [b"".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


class Distance:
    """Gains of windows: their length with the first dictionary less that with each of the others."""

    def __init__(self, *contents: bytes):
        self.packers = [self._packer(c) for c in contents]

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=20, chain_log=20, search_log=3, min_match=5, target_length=8, strategy=zstandard.STRATEGY_DFAST,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)

    def gains(self, windows: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, windows), np.uint64, len(windows))
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u8").tobytes()
        lengths = []
        for packer in self.packers:
            packed = packer.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(windows), segments), threads=1)
            lengths.append(np.fromiter(map(len, packed), np.int64, len(windows)))
        return [lengths[0] - other for other in lengths[1:]]


def features(distance: Distance, texts: list[list[bytes]]) -> np.ndarray:
    """Per coded text: what the calibration weighs."""
    windows, owner = [], []
    for number, words in enumerate(texts):
        found = cut(words)
        windows += found
        owner += [number] * len(found)
    count, length = len(texts), np.array([len(w) for w in texts], float)
    at = np.array(owner, np.int64)
    columns = [np.ones(count), np.log1p(length)]
    for gain in distance.gains(windows) if windows else [np.empty(0, np.int64)] * (len(distance.packers) - 1):
        hits = [np.bincount(at, gain >= t, minlength=count) for t in THRESHOLDS]
        most = np.zeros(count)
        np.maximum.at(most, at, gain)
        total = np.bincount(at, np.maximum(gain, 0), minlength=count)
        columns += [most / CODE, np.log1p(total / CODE), total / (length + 20)]
        columns += [np.log1p(h) for h in hits] + [20 * h / (length + 20) for h in hits]
    return np.stack(columns, axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(rows: list[tuple[int, str, int, float]]) -> bytes | None:
    """A model from (key, text, label, weight); None without both labels."""
    if len({r[2] for r in rows}) < 2:
        return None
    codes = Codes()
    # Texts decide which part they train, so equal texts never stand on both sides.
    part = [zlib.crc32(r[1].encode()) % 3 for r in rows]
    coded = [codes.of(r[1]) for r in rows]
    kinds = {k: [c for c, r, p in zip(coded, rows, part) if r[2] == k and p] for k in (0, 1)}
    counts = {k: Counter(w for words in kinds[k] for w in set(words)) for k in (0, 1)}
    texts = {k: max(1, len(kinds[k])) for k in (0, 1)}
    base, own = (trained([w for words in kinds[k] for w in cut(words)], BASE_BYTES) for k in (0, 1))
    # Training passes over single words: the most frequent ones that it left out are added.
    known = {base[i : i + CODE] for i in range(len(base))}
    often = sorted(counts[0].items(), key=lambda x: (-x[1], x[0]))
    ordinary = base + b"".join([w for w, n in often if n > 2 and w not in known][: OWN_BYTES // CODE])
    lifted = [w for w, n in sorted(counts[1].items(), key=lambda x: (-x[1], x[0]))
              if n >= 2 and n / texts[1] >= LIFT * (counts[0][w] + 0.5) / texts[0]]
    contents = ordinary, ordinary + own, ordinary + b"".join(lifted[: OWN_BYTES // CODE])
    rest = [i for i, p in enumerate(part) if not p] or list(range(len(rows)))
    x = features(Distance(*contents), [coded[i] for i in rest])
    y, weight = np.array([rows[i][2] for i in rest], float), np.array([rows[i][3] for i in rest])
    return pickle.dumps((*contents, logistic(x, y, weight)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, label, weight) to fit on. ``docs`` has key and text, ``labels`` key and label."""
    sizes = docs.where("key is not null").groupBy("key").agg(F.max(F.length("text")).alias("size"))
    known = labels.where("key is not null and label is not null").groupBy("key").agg(F.min("label").cast("int").alias("label"))
    free = stored(known.where(F.col("label").isin(0, 1) & (remainder(F.col("key"), FOLDS) != 0)).join(sizes, "key").withColumn("turn", F.xxhash64("key")), "labelled")
    total = free.groupBy("label").agg(F.count("*").alias("total"))
    first = None
    for label in (0, 1):
        some = free.where(F.col("label") == label).orderBy("turn", "key").limit(SAMPLE_ROWS)
        first = some if first is None else first.unionAll(some)
    before = Window.partitionBy("label").orderBy("turn", "key").rowsBetween(Window.unboundedPreceding, -1)
    taken = first.withColumn("used", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("used") < SAMPLE_CHARS)
    return taken.join(total, "label").select("key", "label", (F.col("total") / F.count("*").over(Window.partitionBy("label"))).alias("weight"))


def model(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """Fit on the sample, in one task; the model has a bounded size."""
    rows = docs.join(F.broadcast(sample(docs, labels)), "key").select("key", "text", "label", "weight").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        found = fit(sorted(held))
        if found is not None:
            yield pa.RecordBatch.from_pydict({"model": [found]})

    one = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(one[0][0]) if one else None


def _scorer(fitted: bytes | None, column: int):
    """Batches and the scores of their rows, in lots of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        codes = Codes()
        if fitted is not None:
            *contents, beta = pickle.loads(fitted)
            distance = Distance(*contents)
        for batch in batches:
            for lot in lots(batch, column):
                if fitted is None:
                    yield lot, np.zeros(lot.num_rows)
                else:
                    x = features(distance, [codes.of(t or "") for t in lot.column(column).to_pylist()])
                    yield lot, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))

    return run


def _fitted(frame: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, label: str) -> bytes | None:
    with_workers(frame.sparkSession)
    return model(text_rows(frame, key, text), labels.select(F.col(f"`{label_key}`").alias("key"), F.col(f"`{label}`").alias("label")))


def score(frame: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per row: key, held_out, score from 0 to 1, predicted label."""
    scores = _scorer(_fitted(frame, labels, key, text, label_key, label), 1)
    docs = text_rows(frame, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, values in scores(batches):
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(values)], names=["key", "score"])

    scored = docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), (remainder(F.col("key"), FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(frame: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The rows that score under 0.5, with all their columns."""
    scores = _scorer(_fitted(frame, labels, key, text, label_key, label), frame.columns.index(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, values in scores(batches):
            yield lot.filter(pa.array(values < 0.5))

    return frame.mapInArrow(run, frame.schema)
