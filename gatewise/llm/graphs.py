"""Connected components of an edge table, and splitting of large groups over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the (a, b) long edges.

    Alternates large-star and small-star steps, so a hub with very many neighbours is
    never gathered: each step is a minimum per node (combined before the shuffle) and an
    equi-join. Every round ends in a written table. Loops and null ends are ignored.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stash(pairs, "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, pairs = pairs, stash(small.distinct(), "edges")
        release(last)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if not now[0] or now == before:
            break
        before = now
    roots = pairs.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


#: Rows of one key that one task of a join takes.
HOT = 100_000


def join_hot(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has a row for each value of ``on`` and in ``n`` (at least) the rows ``left`` has of it.

    Values of more than ``HOT`` rows are dealt, by the column ``by``, to as many copies of
    their row as they need. There are at most rows / ``HOT`` of them, so their list is
    broadcast. Rows of a null value meet nothing and are dealt by ``by`` as well.
    """
    hot = F.broadcast(right.where(F.col("n") > HOT).select(on, F.ceil(F.col("n") / HOT).cast("int").alias("_copies")))
    salt = F.when(F.col(on).isNull(), F.xxhash64(by)).otherwise(F.pmod(F.xxhash64(by), F.coalesce("_copies", F.lit(1))))
    dealt = left.join(hot, on, "left").withColumn("_salt", salt).drop("_copies")
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(F.expr("sequence(0L, coalesce(_copies, 1) - 1L)"))).drop("_copies")
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")


def spread_groups(members: DataFrame, group: str, member: str, weight: str, limit: int) -> DataFrame:
    """Add ``task``: rows that one task takes together, at most about ``2 * limit`` of weight.

    Small groups share tasks. A group beyond ``limit`` is cut into blocks by member and
    every pair of its blocks becomes a task, so each pair of members meets in one task
    and none holds the whole group.
    """
    sizes = members.groupBy(group).agg(F.sum(weight).alias("_w")).withColumn("_blocks", F.ceil(F.col("_w") / limit).cast("int"))
    sizes = stash(sizes, "groups")
    small = sizes.where("_blocks <= 1").agg(F.sum("_w")).first()[0] or 0
    shared = max(1, -(-2 * int(small) // limit))
    joined = members.join(sizes.drop("_w"), group)
    one = joined.where("_blocks <= 1").withColumn("task", F.concat(F.lit("s"), F.expr(f"pmod(xxhash64({group}), {shared})")))
    own = F.expr(f"cast(pmod(xxhash64({member}), _blocks) as int)")
    many = (
        joined.where("_blocks > 1")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("task", F.concat_ws("-", F.col(group), F.least("_own", "_other"), F.greatest("_own", "_other")))
        .drop("_own", "_other")
    )
    return one.unionByName(many).drop("_blocks")
