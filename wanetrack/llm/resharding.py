"""Resharding by minimum-cost flow: near-equal bytes in every shard, fewest bytes moved."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wanetrack.llm.scratch import Scratch

N_SHARDS = 24
ROW_BYTES = 8


def min_cost_flow(
    supply: dict[int, int], capacity: dict[int, int], cost: Callable[[int, int], int]
) -> dict[tuple[int, int], int]:
    """Ships every supply into the capacities at the least total cost.

    Successive shortest paths with potentials. The graph has a node a shard, old or new,
    so its size depends on the shard counts alone; amounts are exact integers.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards cannot hold the old ones")
    left, free = dict(supply), dict(capacity)
    flow: dict[tuple[int, int], int] = {}
    potential = {("o", i): 0 for i in supply} | {("n", j): 0 for j in capacity}
    for source in sorted(supply):
        while left[source]:
            dist, back = {("o", source): 0}, {}
            heap, done = [(0, ("o", source))], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                if u[0] == "o":
                    steps = ((("n", j), cost(u[1], j)) for j in capacity)
                else:
                    steps = ((("o", i), -cost(i, u[1])) for i in supply if flow.get((i, u[1])))
                for v, c in steps:
                    x = d + c + potential[u] - potential[v]
                    if v not in dist or x < dist[v]:
                        dist[v], back[v] = x, u
                        heapq.heappush(heap, (x, v))
            open_ends = [("n", j) for j in sorted(capacity) if free[j] and ("n", j) in dist]
            end = min(open_ends, key=lambda v: dist[v] + potential[v])
            reach = dist[end]
            for v in potential:
                potential[v] += min(dist.get(v, reach), reach)
            path = [end]
            while path[-1] in back:
                path.append(back[path[-1]])
            path.reverse()
            arcs = list(zip(path, path[1:], strict=False))
            amount = min([left[source], free[end[1]], *(flow[v[1], u[1]] for u, v in arcs if u[0] == "n")])
            for u, v in arcs:
                key, sign = ((u[1], v[1]), 1) if u[0] == "o" else ((v[1], u[1]), -1)
                flow[key] = flow.get(key, 0) + sign * amount
            left[source] -= amount
            free[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, n_shards: int) -> dict[int, int]:
    return {j: total // n_shards + (j < total % n_shards) for j in range(n_shards)}


def _exclusive_bases(totals: DataFrame, group: str, value: str, order: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum(value).over(before), F.lit(0))).drop(value)


def reshard(
    docs: DataFrame,
    old_shard: Column,
    n_shards: int = N_SHARDS,
    capacities: dict[int, int] | None = None,
    cost: Callable[[int, int], int] = lambda old, new: int(old != new),
    whole: bool = False,
) -> DataFrame:
    """Plans the transfers from old shards to new ones and places every row.

    The flow between old and new shards is solved on shard totals alone. An old shard's
    rows are laid out from large to small; consecutive byte ranges of that order stay or
    go to the shards that the flow names, each row with the range that holds its middle,
    so rows at range ends are small ones and sizes differ by few bytes. Running sums are
    taken in range partitions and carried over by the partitions' totals, so no shard is
    sorted in one task, however large. Slots count from 0 in each shard without gaps.

    Null texts have size 8 and checksum 0; a null old shard counts as shard 0's
    neighbour -1, which holds rows only before the move; equal rows get different slots;
    an empty table gives no rows; other columns are ignored. With `whole`, a last column
    `doc` holds the row itself, for rewrite_affected().
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(raw).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"),
        *([F.struct("*").alias("doc")] if whole else []),
    )
    order = [F.col("size").desc(), F.col("doc_id"), F.col("text_crc32")]
    laid = scratch.table(
        sized.repartitionByRange("old_shard", *order).withColumn("pid", F.spark_partition_id()), "laid"
    )
    parts = scratch.table(laid.groupBy("old_shard", "pid").agg(F.sum("size").alias("bytes")), "parts")
    supply = {r[0]: int(r[1]) for r in parts.groupBy("old_shard").agg(F.sum("bytes")).collect()}
    capacities = capacities or equal_capacities(sum(supply.values()), n_shards)
    flow = min_cost_flow(supply, capacities, cost)

    ranges, at = [], {}
    for i, j in sorted(flow, key=lambda k: (k[0], cost(*k), k[1])):
        a = at.get(i, 0)
        ranges.append((i, a, a + flow[i, j], j))
        at[i] = a + flow[i, j]
    cuts = (
        spark.createDataFrame(ranges, "old_shard int, lo long, hi long, shard int")
        .groupBy("old_shard")
        .agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("cuts"))
    )
    inside = Window.partitionBy("pid", "old_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    middle = 2 * (F.col("base") + F.col("before")) + F.col("size")
    placed = scratch.table(
        laid.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(_exclusive_bases(parts, "old_shard", "bytes", ["pid"]), ["old_shard", "pid"])
        .join(F.broadcast(cuts), "old_shard")  # at most one row an old shard
        .withColumn("shard", F.filter("cuts", lambda c: 2 * c["hi"] > middle)[0]["shard"])
        .drop("before", "base", "cuts"),
        "placed",
    )
    counts = placed.groupBy("shard", "pid").agg(F.count("*").alias("n"))
    nth = Window.partitionBy("pid", "shard").orderBy("old_shard", *order)
    return (
        placed.withColumn("nth", F.row_number().over(nth) - 1)
        .join(_exclusive_bases(counts, "shard", "n", ["pid"]), ["shard", "pid"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "old_shard", (F.col("old_shard") != F.col("shard")).alias("moved"),
            *(["doc"] if whole else []),
        )
    )


def _free(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def rewrite_affected(plan: DataFrame, path: str) -> DataFrame:
    """Writes the shards whose rows change, and returns the list of (shard) that were rewritten.

    plan is from reshard() with `whole`, so every placed row is written once, without a
    join by id. Files hold the row's own columns and its slot, and lie in folders by shard;
    where a column of the row has one of these names, the new one ends in underscores.
    """
    affected = (
        plan.groupBy("shard").agg(F.max("moved").alias("moved")).filter("moved").select("shard")
        .union(plan.filter("moved").select("old_shard"))
        .distinct()
    )
    own = plan.schema["doc"].dataType.names
    shard, slot = _free("shard", own), _free("slot", own)
    rows = plan.select("shard", "slot", "doc").join(F.broadcast(affected), "shard", "left_semi")
    spread = rows.repartition("shard", (F.col("slot") / 100_000).cast("long"))
    spread.select("doc.*", F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)
    return affected


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by source move into 24 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reshard(docs, F.crc32(F.col("source").cast("binary")) % N_SHARDS)
