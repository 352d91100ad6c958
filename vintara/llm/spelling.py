"""Groups of spelling variants: frequent words one edit apart, found by dense tiles of padded code-point matrices.

Two words are one edit apart when their common prefix and common suffix together reach the longer length minus one; the length of the prefix is then the place
of the edit. A group holds words for one longer length and a range of places: words in it share all before the range and all after it, so only
the part between is laid out as a matrix, from the front and from the back, and blocks of its rows are compared pair by pair. A group of more than ``DENSE``
words is halved at the middle of its range, which gives two groups with longer shared ends. A range of one place leaves one word per
letter, so all groups come down to ``DENSE`` words, each pair of near words meets in one group only, and no pair is lost.

Null texts have no words; rows with a null key count with ``-`` in its place. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import partitions, stored, text_lots, text_rows, with_workers

LEAST_LENGTH, LEAST_COUNT, RATIO, DIVISOR = 6, 5, 5, 199
#: Words of a group that is compared, and of a block of its rows. A range of one place holds one word per letter and one without.
DENSE, TILE = 1024, 256
#: Different words that a worker counts before it hands them on.
HELD = 200_000


def words_of(key: str, text: str, pattern: re.Pattern, divisor: int, least: int) -> list[tuple[str, int]]:
    """Words of a text and how often they occur; a run's word lacks one letter where the divisor divides the crc32 of key and run."""
    out = []
    # The bytes' lower() touches A to Z only.
    for run, count in Counter(pattern.findall(text.encode().lower().decode())).items():
        mark = zlib.crc32(f"{key}:{run}".encode())
        if mark % divisor == 0:
            place = mark % len(run)
            run = run[:place] + run[place + 1 :]
        if len(run) >= least:
            out.append((run, count))
    return out


def vocabulary(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct words (word, n) of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences."""
    with_workers(frame.sparkSession)
    rows = text_rows(frame, key, text).select(F.coalesce(F.col("key").cast("string"), F.lit("-")).alias("key"), "text")
    # A run shorter than the least length has no word, whether it loses a letter or not.
    pattern = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for keys, texts in text_lots(batch):
                for k, t in zip(keys.to_pylist(), texts):
                    for word, n in words_of(k, t, pattern, DIVISOR, LEAST_LENGTH):
                        counts[word] += n
                if len(counts) > HELD:
                    yield out()
        yield out()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= LEAST_COUNT), "vocabulary")


def ranged(words: DataFrame) -> DataFrame:
    """Words in the group of all places: once for pairs whose longer word has their length, once for those one longer."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1))
    return words.select("word", "n", longer.alias("longer")).withColumns({"lo": F.lit(0), "bar": F.col("longer"), "ends": F.lit("")})


def _ends(lo: Column, bar: Column) -> Column:
    """What the words of a group share; prefix and suffix have fixed lengths, so they need no mark between them."""
    after = F.col("longer") - bar
    return F.concat(F.substring("word", F.lit(1), lo), F.when(after > 0, F.expr("right(word, longer - bar)")).otherwise(""))


def halved(groups: DataFrame) -> DataFrame:
    """Every group as two: edits before the middle of the range, and from there on."""
    middle = F.ceil((F.col("lo") + F.col("bar")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("bar")), F.struct(middle.alias("lo"), F.col("bar").alias("bar"))))
    parts = groups.select("word", "n", "longer", part.alias("part")).select("word", "n", "longer", "part.lo", "part.bar")
    return parts.withColumn("ends", _ends(F.col("lo"), F.col("bar")))


def matrix(words: list[bytes], first: int, width: int, back: bool) -> np.ndarray:
    """Code points ``first`` to ``first + width`` of each word from its front or its back, padded with zeros."""
    cut = [(w[::-1] if back else w)[first : first + width].ljust(width, b"\0") for w in words]
    return np.frombuffer(b"".join(cut), np.uint8).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of one matrix with every row of the other."""
    length, alive = np.zeros((len(a), len(b)), np.int32), np.ones((len(a), len(b)), bool)
    for c in range(a.shape[1]):
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        length += alive
    return length


def near_pairs(words: list[str], longer: int, lo: int, bar: int) -> list[tuple[int, int]]:
    """Positions of the words of a group that are one edit apart, the edit lying in its range of places."""
    coded, width = [w.encode("latin-1") for w in words], bar - lo
    size = np.array([len(w) for w in coded])
    front, rear = matrix(coded, lo, width, False), matrix(coded, longer - bar, width, True)
    out = []
    for i in range(0, len(words), TILE):
        for j in range(i, len(words), TILE):
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            before, behind = _common(front[a], front[b]), _common(rear[a], rear[b])
            hit = (before < width) & (before + behind >= width - 1) & ((size[a, None] == longer) | (size[None, b] == longer))
            x, y = np.nonzero(np.triu(hit, 1) if i == j else hit)
            out += zip((x + i).tolist(), (y + j).tolist())
    return out


def compared(groups: DataFrame) -> DataFrame:
    """Near words (word, other, other_n), both ways, of groups of at most ``DENSE`` words."""
    keys = ["longer", "lo", "bar", "ends"]
    dealt = groups.select(*keys, "word", "n").repartition(partitions(groups.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def out() -> pa.RecordBatch:
            found = near_pairs([w for w, _ in held], *current[:3])
            both = found + [(j, i) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in both], pa.string()), pa.array([held[j][0] for _, j in both], pa.string()),
                                               pa.array([held[j][1] for _, j in both], pa.int64())], names=["word", "other", "other_n"])

        for batch in batches:
            for *group, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if group != current:
                    if len(held) > 1:
                        yield out()
                    current, held = group, []
                held.append((word, n))
        if len(held) > 1:
            yield out()

    return dealt.mapInArrow(run, "word string, other string, other_n long")


def near_words(words: DataFrame) -> DataFrame:
    """Every ordered pair of words (word, other, other_n) that are one edit apart, once."""
    keys, found, live = ["longer", "lo", "bar", "ends"], None, ranged(words)
    while True:
        sizes = stored(live.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        # Groups that hold many words are few beside the words, so both joins are on narrow rows.
        part = compared(live.join(sizes.where(F.col("size") <= DENSE).drop("size"), keys))
        found = part if found is None else found.unionAll(part)
        wide = sizes.where(F.col("size") > DENSE).drop("size")
        if wide.isEmpty():
            return found
        live = stored(halved(live.join(wide, keys)), "halved")


def rooted(forms: DataFrame) -> DataFrame:
    """Words with ``root``, the last of the forms reached from them; every step at least multiplies the count, so chains are short and end."""
    now = stored(forms.select("word", "form", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.where("form is not null").select(F.col("word").alias("at"), F.col("root").alias("next"))
        if now.where("form is not null").join(ahead, F.col("root") == F.col("at"), "left_semi").isEmpty():
            return now.select("word", "root")
        moved = now.join(ahead, F.col("root") == F.col("at"), "left")
        now = stored(moved.select("word", "form", F.coalesce("next", "root").alias("root")), "roots")


def variants(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its count, near words, form and root."""
    words = vocabulary(frame, key, text)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    holds = -F.col("best.less") >= F.col("n") * RATIO
    told = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.other")).alias("form"),
                                F.when(holds, -F.col("best.less")).alias("form_n")), "forms")
    return told.join(rooted(told), "word").select("word", "form", "root", "n", "n_near", "form_n")
