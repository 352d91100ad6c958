"""SimHash fingerprints and a Hamming search over permuted block tables, with DataFrame functions only.

Terms are runs of ``WIDTH`` lower-cased words (a shorter text is one run), weighted by how often they occur. Each term is hashed to ``BITS`` bits,
and every bit votes with the term's weight for one or zero; the signs of the votes are the fingerprint. Two bits share a
64-bit counter, so a text can have up to 2**31 terms.

Search: a fingerprint is cut into ``BLOCKS`` blocks. Two fingerprints within the radius agree on at least ``BLOCKS - RADIUS`` blocks, so there is a table
for each choice of that many blocks, keyed by their bits. Rows of a key are compared with its leaders (``buckets.roots``); equal fingerprints are one
row throughout. Tables that grow with the input are joined by merging sorted rows, by a hint: Spark sizes exploded and compressed rows too low and would broadcast them
from the driver.

Null texts are empty; a text without words has the fingerprint of zeros. A null key counts as the smallest key. Repeated rows give repeated rows; where a key has
several texts, its neighbour sees the smallest. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm import buckets
from vintara.llm.common import code_points, sha256, stored, text_rows

WIDTH = 5
BITS = 128
RADIUS, BLOCKS = 6, 8
LEAST = -(2**63)
#: Bits 0 and 32: shifted over a hash, it picks two bits that count in the halves of a sum.
PAIR = (1 << 32) | 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def terms(words: str) -> Column:
    """The runs of words as an array of pairs of hashes; null for no words."""
    run = lambda i: [F.get(F.col(words), i + j) for j in range(WIDTH)]
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*run(i)).alias("a"), F.xxhash64(F.lit(1), *run(i)).alias("b")))
    return F.when(F.size(words) > 0, hashed)


def votes(half: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(F.col(half), k).bitwiseAND(F.lit(PAIR))).alias(f"{half}{k}") for k in range(32)]


def signs(half: str, total: str = "total") -> Column:
    """64 bits: set where more than half of the weight voted for one."""
    bit = lambda count, k: F.shiftleft(F.when(count * 2 > F.col(total), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), k)
    out = None
    for k in range(32):
        low, high = F.col(f"{half}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"{half}{k}"), 32)
        both = bit(low, k).bitwiseOR(bit(high, k + 32))
        out = both if out is None else out.bitwiseOR(both)
    return out


def fingerprints(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """One row per distinct ``by``: the columns, the halves ``high`` and ``low`` of the fingerprint of its text, and how many rows it has."""
    cut = rows.select(*by, words(F.col(text)).alias("words"))  # a column of its own: cut once, looked up many times
    spread = cut.select(*by, F.posexplode_outer(terms("words")).alias("place", "term"))
    spread = spread.select(*by, "place", F.col("term.a").alias("a"), F.col("term.b").alias("b"))
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    counted = spread.groupBy(*by).agg(F.count("a").alias("total"), F.sum(first.cast("long")).alias("copies"), *votes("a"), *votes("b"))
    zero = F.lit(0).cast("long")
    return counted.select(*by, "copies", F.coalesce(signs("a"), zero).alias("high"), F.coalesce(signs("b"), zero).alias("low"))


def text_form(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return 1.0 - distance(a, b) / BITS


def neighbours(keys: DataFrame) -> DataFrame:
    """Each key's next one in descending order, the first after the last. ``keys`` has distinct values of ``key``.

    Keys are dealt by range; only the first key of each range travels to the range before it.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(keys.repartitionByRange(parts, F.desc("key")).select("key", *[c for c in keys.columns if c != "key"], F.spark_partition_id().alias("part")), "ranges")
    inside = Window.partitionBy("part").orderBy(F.desc("key"))
    heads = dealt.groupBy("part").agg(F.max("key").alias("head"))  # a row per range
    over = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.max("head").over(Window.partitionBy())).alias("head"))
    led = dealt.withColumn("lead", F.lead("key").over(inside))
    return led.join(F.broadcast(heads), "part").select(*keys.columns, F.coalesce("lead", "head").alias("next"))


def with_edited(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, next, text, edited): the last third of a text replaced by the beginning of the next document's."""
    rows = text_rows(frame, key, text).select(F.coalesce(F.col("key").cast("long"), F.lit(LEAST)).alias("key"), "text")
    sizes = rows.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    order = stored(neighbours(sizes), "order")
    needs = order.select(F.col("next").alias("key"), F.floor(F.col("n") / 3).cast("int").alias("need"), F.col("key").alias("to"))
    asked = rows.join(order.select("key", "next").hint("merge"), "key")
    given = rows.join(needs.hint("merge"), "key").select("to", F.expr("left(text, need)").alias("piece")).groupBy("to").agg(F.min("piece").alias("piece"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.col("piece").substr(F.lit(1), third))
    return asked.join(given.hint("merge"), F.col("key") == F.col("to")).select("key", "next", "text", edited.alias("edited"))


def classes(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (high, low) with the smallest key of their class: all within the radius of each other, directly or by steps."""
    distinct = stored(prints.groupBy("high", "low").agg(F.min("key").alias("doc")), "prints")
    width = BITS // BLOCKS
    half = BLOCKS // 2
    block = lambda i: F.shiftrightunsigned(F.col("high" if i < half else "low"), width * (i % half)).bitwiseAND(F.lit((1 << width) - 1))
    tables = [F.xxhash64(F.lit(t), *[block(i) for i in chosen]) for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]
    rows = stored(buckets.shared(distinct.select("doc", F.explode(F.array(*tables)).alias("bucket"))), "tables")
    side = lambda name: distinct.select(F.col("doc").alias(name), F.col("high").alias(f"{name}_high"), F.col("low").alias(f"{name}_low"))
    close = distance(("leader_high", "leader_low"), ("member_high", "member_low")) <= RADIUS
    found = buckets.roots(rows, lambda pairs: pairs.join(side("member").hint("merge"), "member").join(side("leader").hint("merge"), "leader").where(close).select("a", "b"))
    if found is None:
        return distinct.select("high", "low", F.col("doc").alias("class_id"))
    return distinct.join(found.select(F.col("key").alias("doc"), "root").hint("merge"), "doc", "left").select("high", "low", F.coalesce("root", "doc").alias("class_id"))


def compare(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and edited text, their likeness, the likeness to the next document, and its class."""
    both = with_edited(frame, key, text).select(
        "key", "next", F.xxhash64("text").alias("i"), F.xxhash64(F.lit(1), "text").alias("j"), code_points(F.col("text")).alias("n_chars"),
        sha256(F.col("edited")).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                                                         F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("part"))
    both = both.select("key", "next", "i", "j", "n_chars", "edited_sha256", F.col("part.kind").alias("kind"), F.col("part.text").alias("text"))
    by = ["key", "next", "i", "j", "n_chars", "edited_sha256", "kind"]
    prints = stored(fingerprints(both, by), "fingerprints")
    own, edited = prints.where("kind = 0").drop("kind"), prints.where("kind = 1").select(
        "key", "i", "j", "edited_sha256", F.col("high").alias("edited_high"), F.col("low").alias("edited_low"))
    least = own.groupBy(F.col("key").alias("next")).agg(F.min(F.struct("high", "low")).alias("to"))
    least = least.select("next", F.col("to.high").alias("next_high"), F.col("to.low").alias("next_low"))
    pairs = own.join(edited.hint("merge"), ["key", "i", "j", "edited_sha256"]).join(least.hint("merge"), "next")
    named = pairs.join(classes(own).hint("merge"), ["high", "low"])
    here = ("high", "low")
    return named.select(
        F.when(F.col("key") != LEAST, F.col("key")).alias(key), "n_chars", "edited_sha256", text_form(*here).alias("fingerprint"),
        text_form("edited_high", "edited_low").alias("edited_fingerprint"), likeness(here, ("edited_high", "edited_low")).alias("near_edited"),
        likeness(here, ("next_high", "next_low")).alias("near_next"), F.when(F.col("class_id") != LEAST, F.col("class_id")).alias("class_id"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
