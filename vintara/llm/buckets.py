"""Classes of rows that share buckets, for operators that verify what they bucket.

Joins of ``shared`` and ``roots`` are sort-merge joins by a hint: Spark sizes exploded rows as if they were not, and would broadcast them from the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import stored

#: Leaders of a round to those of the round before.
GROWTH = 4


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of the edges (a, b) reaches (key, root), by alternating stars; hot nodes are only grouped and joined."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        ups = edges.groupBy("a").agg(F.count("*").alias("n"))
        if not edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() or not edges.join(
                ups.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi").isEmpty():
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            down = large.groupBy("a").agg(F.min("b").alias("low"))
            small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
            edges = stored(small.unionAll(down.select("a", F.col("low").alias("b"))).distinct(), "edges")
        else:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))


def shared(banded: DataFrame) -> DataFrame:
    """The rows (bucket, doc) of buckets that more than one doc has."""
    many = banded.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    return banded.join(many.hint("merge"), F.col("bucket") == F.col("b")).select("bucket", "doc").distinct()


def roots(rows: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Classes (key, root) of the docs in shared buckets; None when no bucket is shared.

    In a bucket the smallest docs lead: all later rows of another class are compared with them by ``verify``, which gets pairs
    (leader, member, a, b) with the classes a and b of both and keeps those that hold. A bucket is done when its rows that have not led yet are of
    one class. Each round has ``GROWTH`` times the leaders, so the rounds are few, and no link between rows of different
    classes is left out. Leaders are found by a limit within tasks, and classes joined by their roots only, so a bucket with very many rows
    lies in one task at no time.
    """
    live, found, leaders = stored(rows.withColumn("root", F.col("doc")), "live"), None, 1
    while not live.isEmpty():
        first = F.row_number().over(Window.partitionBy("bucket").orderBy("doc"))
        heads = stored(live.withColumn("place", first).where(F.col("place") <= leaders).select(
            F.col("bucket").alias("b"), F.col("doc").alias("leader"), F.col("root").alias("head_root")), "heads")
        met = live.join(heads.hint("merge"), (F.col("bucket") == F.col("b")) & (F.col("root") != F.col("head_root")) & (F.col("doc") > F.col("leader")))
        pairs = met.select("leader", F.col("doc").alias("member"), F.col("head_root").alias("a"), F.col("root").alias("b")).distinct()
        joined = components(verify(pairs).select("a", "b"))
        if found is None:
            found = joined
        else:
            later = joined.select(F.col("key").alias("root"), F.col("root").alias("next"))
            found = stored(found.join(later.hint("merge"), "root", "left").select("key", F.coalesce("next", "root").alias("root")).unionAll(joined), "roots")
        last = heads.groupBy(F.col("b")).agg(F.max("leader").alias("last"))
        rest = live.join(last.hint("merge"), (F.col("bucket") == F.col("b")) & (F.col("doc") > F.col("last"))).select("bucket", "doc", "root")
        moved = rest.join(joined.select(F.col("key").alias("root"), F.col("root").alias("next")).hint("merge"), "root", "left")
        now = moved.select("bucket", "doc", F.coalesce("next", "root").alias("root"))
        apart = now.groupBy(F.col("bucket").alias("b")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        live = stored(now.join(apart.hint("merge"), F.col("bucket") == F.col("b")).select("bucket", "doc", "root"), "live")
        leaders *= GROWTH
    return found
