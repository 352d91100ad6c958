"""Merkle manifest of a table: a tree of digests per group, a root over the groups, and a proof per row.

Every aligned block of ``arity ** depth`` nodes keeps each of its levels as one string of hex digests. Parents are hashes of fixed-width
substrings, the siblings of a node are the substrings that flank it in its run, and the tops of the blocks are the nodes of the next
round, so a tree of any size needs as many rounds as its count has digits to the base ``arity ** depth``. Rows are numbered in their group
by one range shuffle of digests; texts are read once and never shuffled.

A null field is hashed as ``-`` and differs from an empty one. Rows with a null group form the first group, rows with a null key stand first in theirs, rows
that share a key stand in order of their leaves, and repeated rows are leaves of their own. A group of one leaf has it as its subroot, a single group
has the root equal to its subroot. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import placed, stored, with_each

ARITY, DEPTH = 2, 8
DIGEST = 64


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: every field as byte count and value, or ``-``."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return digest(F.concat(*told))


def group_key(group: Column) -> Column:
    """A string per group that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def parents(level: Column, arity: int) -> Column:
    """The next level of a block: digests of its runs of ``arity`` nodes, the last of which may be shorter."""
    width = DIGEST * arity
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda j: digest(F.substring(level, j * width + 1, F.lit(width)))), "")


def levels(nodes: Column, alone: Column, arity: int, depth: int) -> Column:
    """All levels of a block from its nodes up; a block that is its whole tree ends where one node remains."""
    def higher(so_far: Column, _: Column) -> Column:
        last = F.element_at(so_far, -1)
        return F.when(alone & (F.length(last) == DIGEST), so_far).otherwise(F.concat(so_far, F.array(parents(last, arity))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(nodes), higher)


def steps(levels_of: Column, at: Column, arity: int) -> Column:
    """The siblings of the node at a place of its block, level by level: what stands left and right of it in its run."""
    def step(i: Column) -> Column:
        level, place = F.element_at(levels_of, i + 1), F.floor(at / F.pow(F.lit(arity), i)).cast("int")
        run = place - place % arity
        left = F.substring(level, run * DIGEST + 1, (place - run) * DIGEST)
        return F.struct(left.alias("left"), F.substring(level, (place + 1) * DIGEST + 1, (run + arity - 1 - place) * DIGEST).alias("right"))

    none = F.array().cast("array<struct<left:string,right:string>>")
    return F.when(F.size(levels_of) > 1, F.transform(F.sequence(F.lit(0), F.size(levels_of) - 2), step)).otherwise(none)


def trees(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """One tree per group. ``nodes`` has group, pos, total, node and carried (any column to keep).

    Returns the top of each group (group, top) and the blocks of every round, which ``proofs`` reads.
    """
    size, rounds, tops = arity**depth, [], []
    while True:
        block = F.floor(F.col("pos") / size).alias("block")
        members = F.sort_array(F.collect_list(F.struct("pos", "node", "carried"))).alias("members")
        held = nodes.groupBy("group", block).agg(F.first("total").alias("total"), members)
        whole = F.array_join(F.transform("members", lambda m: m["node"]), "")
        blocks = stored(held.withColumn("levels", levels(whole, F.col("total") <= size, arity, depth)), "blocks")
        rounds.append(blocks)
        top = F.element_at("levels", -1)
        tops.append(blocks.where(F.col("total") <= size).select("group", top.alias("top")))
        higher = blocks.where(F.col("total") > size)
        if higher.isEmpty():
            break
        nodes = higher.select("group", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), top.alias("node"), F.lit(None).alias("carried"))
    found = tops[0]
    for more in tops[1:]:
        found = found.unionAll(more)
    return found, rounds


def proofs(rounds: list[DataFrame], roots: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Every node of the first round with all columns of ``roots`` (group, above, ...) and ``steps``, its siblings up to the top of its group and then ``above``."""
    size, higher = arity**depth, None
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number]
        none = F.array().cast("array<struct<left:string,right:string>>")
        blocks = blocks.withColumn("over", none) if higher is None else blocks.join(higher, ["group", "block"], "left").withColumn("over", F.coalesce("over", none))
        if number == 0:
            blocks = with_each(stored(blocks, "proven"), roots, "group").withColumn("over", F.concat("over", "above")).drop("above")
        each = blocks.withColumn("member", F.explode("members")).drop("members", "block", "total")
        own = steps(F.col("levels"), (F.col("member.pos") % size).cast("int"), arity)
        each = each.withColumn("steps", F.concat(own, "over")).drop("levels", "over")
        higher = each.select("group", F.col("member.pos").alias("block"), F.col("steps").alias("over"))
    return each.withColumns({"pos": F.col("member.pos"), "node": F.col("member.node"), "carried": F.col("member.carried")}).drop("member")


def manifest(leaves: DataFrame, carried: list[str], arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Rows of a table of leaves (group, key, leaf and the carried columns) with subroot, root and steps.

    ``group`` comes from ``group_key``.
    """
    kept = stored(leaves.select("group", "key", "leaf", F.struct(*carried).alias("carried"), F.monotonically_increasing_id().alias("tie")), "leaves")
    nodes = placed(kept, "group", ["key", "leaf", "tie"]).select("group", "pos", "total", F.col("leaf").alias("node"), "carried")
    tops, rounds = trees(nodes, arity, depth)
    named = placed(tops.select(F.lit("").alias("all"), "group", "top"), "all", ["group"])
    top, upper = trees(named.select(F.col("all").alias("group"), "pos", "total", F.col("top").alias("node"), F.col("group").alias("carried")), arity, depth)
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = proofs(upper, top.select("group", none.alias("above"), F.col("top").alias("root")), arity, depth)
    roots = stored(over.select(F.col("carried").alias("group"), F.col("steps").alias("above"), F.col("node").alias("subroot"), "root"), "roots")
    return proofs(rounds, roots, arity, depth).select("carried.*", F.col("node").alias("leaf"), "subroot", "root", "steps")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof(path: Column) -> Column:
    """The digest of all siblings of a proof, in order."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def tampered(frame: DataFrame, key: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             divisor: int = 7) -> DataFrame:
    """Every row with its leaf, roots and proof, checked after one is added to the count of those rows whose key has a crc32 that the divisor divides."""
    own, hit = {f: F.col(f"`{f}`") for f in fields}, F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % divisor == 0, F.lit(False))
    changed = own | {count: F.when(hit, own[count] + 1).otherwise(own[count])}
    rows = frame.select(group_key(F.col(f"`{group}`")).alias("group"), F.col(f"`{key}`").alias("key"), leaf(list(own.values())).alias("leaf"),
                        F.when(hit, leaf(list(changed.values()))).alias("altered"))
    rooted = manifest(rows, ["key", "altered"])
    again = rooted.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    return again.select(F.col("key").alias(key), "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
