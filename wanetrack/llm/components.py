"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanetrack.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the least of them. Edges point from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Rows (u, v): v is the least node reachable from u, for every node but the least ones themselves.

    edges: u, v of one type; loops and repeats are allowed, direction is ignored. Each
    round joins a node with its own minimum, so a node with many neighbours is split like
    any skewed join and no neighbourhood is ever gathered. Rounds end when an alternation
    changes nothing; their number grows with the logarithm of the largest component.
    """
    now = scratch.table(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(max_rounds):
        large = scratch.table(_large_star(now), "large")
        nxt = scratch.table(_small_star(large), "small")
        scratch.drop(now, large)
        now, before, state = nxt, state, _state(nxt)
        if state == before:
            return now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def settle_buckets(
    members: DataFrame, scratch: Scratch, rounds: int,
    verified: Callable[[DataFrame], DataFrame], verified_open: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, parts) of nodes that share buckets: members has rows (bucket, node), each once.

    In each of `rounds`, every bucket that holds nodes of several components has a pivot,
    another one by round, and verified((u, v)) tells which of its nodes of other
    components are linked with it. So a bucket of any size costs one pair a node and
    round, and copies settle in the first. The members of buckets that are then still
    open, (bucket, n, node, part), go to verified_open. links is the union of all that
    both returned, u and v first; parts is as from connected_components(); None where no
    bucket holds two nodes.
    """
    links, parts = None, None
    for k in range(rounds + 1):
        label = parts.select(F.col("u").alias("node"), F.col("v").alias("part")) if parts is not None else None
        now = members.withColumn("part", F.col("node")) if label is None else (
            members.join(label, "node", "left").withColumn("part", F.coalesce("part", "node"))
        )
        now = scratch.table(now.select("bucket", "node", "part"), "now")
        turn = F.struct(F.xxhash64("node", F.lit(k)) if k else F.lit(0), "node", "part")
        mixed = now.groupBy("bucket").agg(
            F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n"), F.min(turn).alias("pivot")
        )
        mixed = mixed.filter("a < b").select("bucket", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.part").alias("at"))
        opened = scratch.table(now.join(mixed, "bucket"), "open")
        scratch.drop(now)
        if opened.isEmpty():
            break
        if k < rounds:
            pairs = opened.filter("part <> at").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
            found = verified(scratch.table(pairs, "pairs"))
        else:
            found = verified_open(opened.select("bucket", "n", "node", "part"))
        found = scratch.table(found, "found")
        links = found if links is None else links.union(found)
        edges = found.select("u", "v")
        parts = connected_components(edges if parts is None else parts.union(edges), scratch)
        members = opened.select("bucket", "node")
    return links, parts
