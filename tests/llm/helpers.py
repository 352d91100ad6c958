"""Small tables with the cases every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
         "river stone cloud window garden letter engine market winter summer copper silver").split()


def prose(seed: int, words: int) -> str:
    source = random.Random(seed)
    return " ".join(source.choice(WORDS) + (source.choice([".", ",", ""]) if source.random() < 0.2 else "") for _ in range(words))


def documents(spark: SparkSession) -> DataFrame:
    """Documents with odd cases and columns whose names operators use themselves."""
    long = prose(9, 6000)
    near = prose(1, 120).split()
    near[60] = "changed"
    rows = [(1, prose(1, 120)), (2, prose(1, 120)), (3, " ".join(near)), (4, prose(2, 90)), (5, None), (6, ""), (7, "  \n "), (8, long),
            (9, "one"), (10, "a b  c\n\n d <|endoftext|> é漢字 🙂"), (11, prose(3, 40)), (11, prose(3, 40)), (12, prose(4, 70).upper()), (None, prose(5, 50))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", *[F.lit(7).alias(c) for c in ("key", "digest", "score", "bucket", "row", "n", "ids")])


def empty(frame: DataFrame) -> DataFrame:
    return frame.where("1 = 0")


def pairs(frame: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
