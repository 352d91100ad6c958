"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

Tokens are the words of a text, lower-cased in ASCII and cut at ASCII white space, and an end. The ``HEAD`` most frequent training tokens form classes
of ``MEMBERS`` by frequency; all other words fall into ``TAILS`` classes by a hash of their ending. The probability of a token is that of its class given
the words before it, times that of the token in its class: for head classes another softmax over the members, for tail classes the
share of the word among the class's training tokens, plus one for each known word and one for unknown ones. So the
probabilities of all events after a history add up to one.

Both softmaxes are log-linear in hashed features: the last word, the last two (n-grams), and the words two and three back (skips). Words outside the head
count as their class in a feature. Training starts from the counts and runs ``ROUNDS`` rounds: in each, every task takes gradient steps over its share of that
round's texts, and the changes of all tasks are averaged, weighted by tokens, block by block. All training texts are used.

Counts are over all training tokens. The ``KNOWN`` most frequent counts are sent to the tasks; all rarer words are joined with the count table
by word, so nothing is cut off and no frequent word makes a hot key. The weights have a fixed size. Null texts are empty: an end only. Rows with
a null key are scored and not learned from; repeated rows count each time. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import large_lots, lots, remainder, stored, text_rows, with_workers

FOLDS, HELD_OUT = 7, 2
HEAD, MEMBERS, TAILS = 1024, 64, 16
HEADS = HEAD // MEMBERS
CLASSES = HEADS + TAILS
#: Histories: head words, tail classes, and the place before a text.
SYMBOLS = HEAD + TAILS + 1
PAIRS, INNER = 1 << 13, 1 << 13
KNOWN = 200_000
REMEMBERED = 200_000
ROUNDS, RATE, STEP = 2, 0.25, 8_192
BLOCK = 4_096
#: Tokens whose softmax is worked out together, and the most occurrences of a row that are summed one by one.
PART, SELDOM = 1024, 8
#: Texts that a task cuts into words together, in bytes.
LOT = 16 << 20
#: The end of a text; no word holds white space.
END = b"\n"
UNKNOWN = 1 << 30
_ENDS = b".,;:!?)\"'"


def tail_class(word: bytes) -> int:
    """The class of a word outside the head: a hash of its last three bytes before punctuation."""
    return zlib.crc32(word.rstrip(_ENDS)[-3:]) % TAILS


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def spelled(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Many texts at once: the distinct words, the place among them of every word in sequence, and the words of each text; ends are left out."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, size = int(bounds[0]), int(bounds[-1] - bounds[0])
    if not size:
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    lower = np.frombuffer(data.slice(base, size).to_pybytes().lower(), np.uint8)
    bounds = bounds - base
    black = ~WHITE[lower]
    first = black.copy()
    first[1:] &= ~black[:-1]
    begin = bounds[:-1][bounds[:-1] < size]
    first[begin] = black[begin]
    letters, starts = lower[black], np.flatnonzero(first[black])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(letters))), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    counts = np.diff(np.searchsorted(np.flatnonzero(first), bounds))
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), counts


def spelled_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What ``spelled`` gives for many batches, cut into their lots: keys, distinct words, places of the lot's words, words of each text."""
    for held in large_lots(batches, LOT):
        distinct, places, counts = spelled(pa.Table.from_batches(held).column(1).combine_chunks())
        row, word = 0, 0
        for batch in held:
            for lot in lots(batch):
                some = counts[row : row + lot.num_rows]
                end = word + int(some.sum())
                yield lot.column(0), distinct, places[word:end], some
                row, word = row + lot.num_rows, end


class Lexicon(dict):
    """Numbers of tokens: their rank if they are known, else ``UNKNOWN`` and their class."""

    def __init__(self, ranked: list[bytes]):
        super().__init__((w, n) for n, w in enumerate(ranked))
        self.size = len(self)
        self.ranked = ranked

    def __missing__(self, word: bytes) -> int:
        self[word] = value = UNKNOWN + tail_class(word)
        return value

    def trim(self) -> None:
        if len(self) > self.size + REMEMBERED:
            self.clear()
            self.update((w, n) for n, w in enumerate(self.ranked))


class Model:
    """Weights of both softmaxes, in one vector of fixed size."""

    SHAPES = ((3 * SYMBOLS + PAIRS, CLASSES), (1, CLASSES), (INNER, MEMBERS), (HEADS, MEMBERS))

    def __init__(self, weights: np.ndarray, head: int):
        self.weights, self.head, at, parts = weights, head, 0, []
        for rows, columns in self.SHAPES:
            parts.append(weights[at : at + rows * columns].reshape(rows, columns))
            at += rows * columns
        self.outer, self.bias, self.inner, self.inner_bias = parts
        self.open = np.where(np.arange(HEAD).reshape(HEADS, MEMBERS) < head, 0, -1e9).astype(np.float32)
        self.shut = np.where(np.arange(CLASSES) * MEMBERS < head, 0, -1e9).astype(np.float32)  # head classes without members
        self.shut[HEADS:] = 0

    @classmethod
    def size(cls) -> int:
        return sum(r * c for r, c in cls.SHAPES)

    @classmethod
    def start(cls, counts: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Weights that give the training frequencies, whatever came before."""
        weights = np.zeros(cls.size(), np.float32)
        model = cls(weights, len(counts))
        padded = np.zeros(HEAD)
        padded[: len(counts)] = counts
        model.bias[0] = np.log(np.concatenate([padded.reshape(HEADS, MEMBERS).sum(axis=1), tails]) + 0.5)
        model.inner_bias[:] = np.log(padded + 0.5).reshape(HEADS, MEMBERS)
        return weights

    def events(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Class, member, and the feature rows of both softmaxes for every token of several texts."""
        unknown = numbers >= UNKNOWN
        inside = numbers < self.head
        group = np.where(inside, numbers // MEMBERS, HEADS + np.where(unknown, numbers - UNKNOWN, self.tails[np.where(unknown, 0, numbers)]))
        symbol = np.where(inside, numbers, HEAD - HEADS + group)
        place = np.arange(len(numbers)) - starts
        at = np.arange(len(numbers))
        back = [np.where(place >= k, symbol[np.maximum(at - k, 0)], SYMBOLS - 1) for k in (1, 2, 3)]
        pair = (back[0] * 40_503 + back[1] * 9_973) % PAIRS
        outer = np.stack([back[0], SYMBOLS + back[1], 2 * SYMBOLS + back[2], 3 * SYMBOLS + pair])
        inner = np.stack([(group * 7_919 + back[0] * 40_503) % INNER, (group * 7_919 + back[1] * 30_011 + 17) % INNER])
        return group, numbers, inside, outer, inner

    def chances(self, group, numbers, inside, outer, inner) -> tuple[np.ndarray, ...]:
        """Exponentials and their sums, for the classes and for the members of tokens in the head, by parts that stay in the processor's cache."""
        at = np.flatnonzero(inside)
        a, b = np.empty((len(group), CLASSES), np.float32), np.empty((len(at), MEMBERS), np.float32)
        bias, inner_bias = self.bias + self.shut, self.inner_bias + self.open
        a_sums = self._exponentials(a, [(self.outer, row) for row in outer], bias, None)
        b_sums = self._exponentials(b, [(self.inner, row[at]) for row in inner], inner_bias, group[at])
        return a, a_sums, b, b_sums, at

    @staticmethod
    def _exponentials(out: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], biases: np.ndarray, which: np.ndarray | None) -> np.ndarray:
        sums = np.empty((len(out), 1), np.float32)
        held = np.empty((PART, out.shape[1]), np.float32)
        for lo in range(0, len(out), PART):
            a = out[lo : lo + PART]
            more = held[: len(a)]
            (table, rows), *others = parts
            np.take(table, rows[lo : lo + PART], axis=0, out=a, mode="clip")
            for table, rows in others:
                a += np.take(table, rows[lo : lo + PART], axis=0, out=more, mode="clip")
            a += biases if which is None else np.take(biases, which[lo : lo + PART], axis=0, out=more, mode="clip")
            a -= a.max(axis=1, keepdims=True)
            np.exp(a, out=a)
            a.sum(axis=1, keepdims=True, out=sums[lo : lo + PART])
        return sums

    def log_probability(self, events: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of the modelled part for each token, in steps of bounded size."""
        out = np.zeros(len(events[0]))
        for lo in range(0, len(out), STEP):
            group, numbers, inside, outer, inner = (e[..., lo : lo + STEP] for e in events)
            a, a_sums, b, b_sums, at = self.chances(group, numbers, inside, outer, inner)
            part = np.log10(np.maximum(a[np.arange(len(group)), group] / a_sums[:, 0], 1e-30)).astype(float)
            part[at] += np.log10(np.maximum(b[np.arange(len(at)), numbers[at] % MEMBERS] / b_sums[:, 0], 1e-30))
            out[lo : lo + STEP] = part
        return out

    def learn(self, events: tuple[np.ndarray, ...], memory: list[np.ndarray]) -> None:
        """Gradient steps over tokens, each scaled by the gradients its row has seen."""
        for lo in range(0, len(events[0]), STEP):
            group, numbers, inside, outer, inner = (e[..., lo : lo + STEP] for e in events)
            a, a_sums, b, b_sums, at = self.chances(group, numbers, inside, outer, inner)
            a /= -a_sums
            a[np.arange(len(group)), group] += 1
            b /= -b_sums
            b[np.arange(len(at)), numbers[at] % MEMBERS] += 1
            for rows in outer:
                self._step(self.outer, memory[0], rows, a)
            self._step(self.bias, memory[1], np.zeros(len(group), np.int64), a)
            for rows in inner:
                self._step(self.inner, memory[2], rows[at], b)
            self._step(self.inner_bias, memory[3], group[at], b)

    @staticmethod
    def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        if not len(rows):
            return
        which, total = row_sums(rows, gradient)
        seen[which] += (total * total).mean(axis=1)
        table[which] += RATE * total / np.sqrt(seen[which] + 1.0)[:, None]


def row_sums(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers, all below 65,536, and the sums of the gradients of each.

    The sums are those of ``np.add.reduceat``, to the last bit. It takes rows that occur seldom by far too slowly, so these are summed
    by their second, third, ... occurrences, many rows at once.
    """
    if not rows.any():
        return np.zeros(1, np.int64), np.add.reduceat(gradient, [0], axis=0)
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # by radix
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(np.append(first, len(rows)))
    by = np.argsort(-np.minimum(times, SELDOM + 1).astype(np.int8), kind="stable")
    first, times = first[by], times[by]
    many = int(np.count_nonzero(times > SELDOM))
    total = np.empty((len(first), gradient.shape[1]), np.float32)
    if many:
        sizes = times[:many]
        begin = np.cumsum(sizes) - sizes
        places = np.repeat(first[:many] - begin, sizes) + np.arange(sizes.sum())
        total[:many] = np.add.reduceat(gradient.take(order[places], axis=0, mode="clip"), begin, axis=0)
    if many < len(first):
        rest, start, times = total[many:], first[many:], times[many:]
        gradient.take(order[start], axis=0, mode="clip", out=rest)
        twice = int(np.count_nonzero(times > 1))
        later = gradient.take(order[start[:twice] + 1], axis=0, mode="clip")
        for k in range(2, SELDOM):
            live = int(np.count_nonzero(times > k))
            later[:live] += gradient.take(order[start[:live] + k], axis=0, mode="clip")
        rest[:twice] += later
    return ordered[first], total


def _model(weights: np.ndarray, head: int, tails: np.ndarray) -> Model:
    model = Model(weights, head)
    model.tails = tails
    return model


class Numbering:
    """Numbers of tokens in lots; the distinct words of a run of lots are looked up once."""

    def __init__(self, ranked: list[bytes]):
        self.lexicon, self.distinct, self.numbers = Lexicon(ranked), None, None

    def of(self, distinct: pa.Array, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all tokens, ends included, and for each token the place of its text's first one."""
        if distinct is not self.distinct:
            self.lexicon.trim()
            words = distinct.to_numpy(zero_copy_only=False).tolist()
            self.distinct, self.numbers = distinct, np.fromiter(map(self.lexicon.__getitem__, words), np.int64, len(words))
        sizes = counts + 1
        numbers = np.insert(self.numbers[places], np.cumsum(counts), self.lexicon[END])
        return numbers, np.repeat(np.cumsum(sizes) - sizes, sizes)


def count_tokens(rows: DataFrame) -> DataFrame:
    """Occurrences of every token in the texts (token, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in large_lots(batches, LOT):
            distinct, places, counts = spelled(pa.Table.from_batches(held).column(1).combine_chunks())
            times = np.append(np.bincount(places, minlength=len(distinct)), len(counts))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([distinct, pa.array([END], pa.binary())]), pa.array(times, pa.int64())], names=["token", "n"])

    return rows.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The tokens above the count that at most ``KNOWN`` tokens reach, by frequency, and their counts.

    The count is found from a histogram with steps of an eighth of an octave, so tasks send only its cells and then the tokens themselves.
    """
    cells = counts.groupBy(F.floor(F.log2("n") * 8).alias("cell")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect()
    least, taken = None, 0
    for cell in sorted(cells, key=lambda c: -c["cell"]):
        taken += cell["tokens"]
        if taken > KNOWN:
            break
        least = cell["least"]
    if least is None:
        return [], np.empty(0)
    found = counts.where(F.col("n") >= least).toArrow()
    words, sizes = found.column("token").to_pylist(), found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-sizes[i], words[i]))
    return [words[i] for i in order], sizes[order].astype(float)


def tail_totals(counts: DataFrame, head: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each tail class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in head:
                    group = tail_class(word)
                    n[group] += count
                    v[group] += 1
        yield pa.RecordBatch.from_pydict({"group": pa.array(range(TAILS), pa.int32()), "n": n, "v": v})

    n, v = np.zeros(TAILS), np.zeros(TAILS)
    for row in counts.mapInArrow(run, "group int, n long, v long").groupBy("group").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[row["group"]], v[row["group"]] = row["n"], row["v"]
    return n, v


def train(rows: DataFrame, sent, weights: np.ndarray) -> np.ndarray:
    """Rounds of gradient steps in every task, each round's changes averaged over the tasks."""
    spark = rows.sparkSession
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranked, head, tails = sent.value[:3]
            numbering, mine, seen = Numbering(ranked), now.value.copy(), 0
            model = _model(mine, head, tails)
            memory = [np.zeros(shape[0], np.float32) for shape in Model.SHAPES]
            for _, *lot in spelled_lots(batches):
                numbers, starts = numbering.of(*lot)
                model.learn(model.events(numbers, starts), memory)
                seen += len(numbers)
            if seen:
                change = (mine - now.value) * np.float32(seen)
                blocks = range(0, len(change), BLOCK)
                kept = [i for i in blocks if change[i : i + BLOCK].any()]
                place = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // BLOCK for i in kept] + [-1], pa.int32()), pa.array([place] * (len(kept) + 1), pa.int32()),
                     pa.array([change[i : i + BLOCK].tobytes() for i in kept] + [np.array([seen], np.float32).tobytes()], pa.binary())],
                    names=["block", "place", "change"])

        changes = rows.where(F.col("turn") == turn).select("key", "text").mapInArrow(run, "block int, place int, change binary")
        halves = changes.groupBy("block", "place").applyInArrow(_added, "block int, place int, change binary")
        total = {r["block"]: np.frombuffer(r["change"], np.float32) for r in halves.groupBy("block").applyInArrow(_added, "block int, place int, change binary").collect()}
        if -1 in total:
            weights, seen = weights.copy(), total.pop(-1)[0]
            for block, change in total.items():
                weights[block * BLOCK : block * BLOCK + len(change)] += change / seen
        now.unpersist()
    return weights


def _added(rows: pa.Table) -> pa.Table:
    """The sum of the changes of one block; a task sends one row, and places split them first."""
    total = None
    for change in rows.column("change"):
        part = np.frombuffer(change.as_py(), np.float32)
        total = part.copy() if total is None else total + part
    return pa.Table.from_arrays([rows.column("block").slice(0, 1), rows.column("place").slice(0, 1), pa.array([total.tobytes()], pa.binary())],
                                names=["block", "place", "change"])


def _bags(distinct: pa.Array, places: np.ndarray, counts: np.ndarray, rare: np.ndarray) -> pa.MapArray:
    """The rare tokens of each text and how often they occur in it; ``rare`` also has the ends, which may be rare themselves."""
    words, width = pa.concat_arrays([distinct, pa.array([END], pa.binary())]), len(distinct) + 1
    owner = np.repeat(np.arange(len(counts)), counts + 1)[rare]
    found, times = np.unique(owner * width + np.insert(places, np.cumsum(counts), len(distinct))[rare], return_counts=True)
    offsets = np.searchsorted(found, np.arange(len(counts) + 1) * width).astype(np.int32)
    return pa.MapArray.from_arrays(offsets, words.take(pa.array(found % width)), pa.array(times, pa.int32()))


def score(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = frame.sparkSession
    with_workers(spark)
    fold = remainder(F.col("key"), FOLDS)
    rows = text_rows(frame, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    learned = rows.where(fold != HELD_OUT).withColumn("turn", F.pmod(F.xxhash64("key"), ROUNDS))
    counts = stored(count_tokens(learned), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranked, known = most_frequent(counts)
    head = min(HEAD, len(ranked))
    n, v = tail_totals(counts, set(ranked[:head]))
    tails = np.array([tail_class(w) for w in ranked] or [0], np.int64)
    sent = spark.sparkContext.broadcast((ranked, head, tails, np.log10(known + 1), np.log10(n + v + 1)))
    weights = spark.sparkContext.broadcast(train(learned, sent, Model.start(known[:head], n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, head, tails, logs, sizes = sent.value
        numbering, model, row = Numbering(ranked), _model(weights.value, head, tails), TaskContext.get().partitionId() << 33
        logs = logs if len(logs) else np.zeros(1)
        for keys, distinct, places, counts in spelled_lots(batches):
            numbers, starts = numbering.of(distinct, places, counts)
            events = model.events(numbers, starts)
            rare = numbers >= UNKNOWN
            count = np.where(rare, 0.0, logs[np.where(rare, 0, numbers)])  # log10(c + 1)
            part = model.log_probability(events)
            part += np.where(events[2], 0.0, count - sizes[np.maximum(events[0] - HEADS, 0)])
            ends = np.cumsum(counts + 1)
            begin = ends - counts - 1
            sums = [np.add.reduceat(x, begin) for x in (count, part, ~rare)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(keys))), keys, pa.array(counts + 1, pa.int64()), pa.array(sums[2].astype(np.int64)),
                 pa.array(sums[0]), pa.array(sums[1]), _bags(distinct, places, counts, rare)],
                names=["row", "key", "n_tokens", "n_known", "counted", "part", "rare"])
            row += len(keys)

    scored = stored(rows.mapInArrow(run, f"row long, key {kind}, n_tokens long, n_known long, counted double, part double, rare map<binary,int>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("token", "times"))
    found = rare.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    whole = scored.drop("rare").join(found, "row", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(
        F.col("key").alias(key), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + more("more")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("counted") + more("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("part") + more("logs")).alias("score"))
