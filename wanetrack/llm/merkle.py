"""Merkle manifests: a binary hash tree a group under one root, and inclusion proofs by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from wanetrack.llm.scratch import Scratch

#: Levels that one task builds at once: a block has at most two to this many nodes at its foot.
STEP = 10
#: A level of a path: a side and the sibling's digest.
LINK = 33
ALONE, LEFT, RIGHT = 0, 1, 2
#: Bytes up to which the ancestors of a round, or the groups, may be broadcast.
BROADCAST_BYTES = 8 << 20


def digest(*fields: Column) -> Column:
    """sha256 over the fields, each `-` if null, else its UTF-8 byte count, `:` and its value; as 32 bytes."""

    def part(c: Column) -> Column:
        raw = c.cast("string").cast("binary")
        return F.coalesce(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(b":"), raw), F.lit(b"-"))

    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path lead to."""
    at, rest = leaf.hex(), path.hex()
    for i in range(0, len(rest), 2 * LINK):
        side, other = rest[i + 1], rest[i + 2 : i + 2 * LINK]
        at = _h(at if side == "0" else other + at if side == "1" else at + other)
    return bytes.fromhex(at)


def siblings(path: bytes) -> str:
    """The digests on a path from the leaf to the root, as one hex text."""
    rest = path.hex()
    return "".join(rest[i + 2 : i + 2 * LINK] for i in range(0, len(rest), 2 * LINK) if rest[i + 1] != "0")


@F.pandas_udf(BinaryType())
def folded(leaf: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([fold(a, b) for a, b in zip(leaf, path, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def siblings_sha256(path: pd.Series) -> pd.Series:
    return pd.Series([_h(siblings(p)) for p in path], dtype=object)


def _bounded(side: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint where the rows, counted, fit; else Spark joins by shuffles and splits hot keys."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def _placed(df: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """df with `place`, the row's number from 0 in that order, nulls first, strings bytewise.

    Ranges are sorted in parallel; a range's rows are numbered where they lie, and its
    base is the sum of the counts before it (one row a range).
    """
    laid = scratch.table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "laid")
    pid = F.shiftright("_m", 33)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = laid.groupBy(pid.alias("_pid")).agg(F.min("_m").alias("_first"), F.count("*").alias("_n")).select(
        "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    )
    return laid.withColumn("_pid", pid).join(_bounded(bases, 64), "_pid").withColumn("place", F.col("_m") + F.col("_base")).drop("_m", "_pid", "_base")


def _height(n: Column) -> Column:
    """Levels above n nodes: how often n halves, rounded up, until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _block(level: int, row_type: pa.DataType | None = None) -> Callable[[pa.Table], pa.Table]:
    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        gid, height, first = (block.column(c)[0].as_py() for c in ("gid", "height", "idx"))
        nodes = [d.hex() for d in block.column("digest").to_pylist()]
        rows = block.column("row").combine_chunks()
        up = min(STEP, height - level)
        levels, places, segs = [], [], []
        if up == 0:  # a group of one leaf
            levels, places, segs = [level], [first], [b""]
        for k in range(up):
            base = first >> k
            for i, _ in enumerate(nodes):
                j = i ^ 1
                if j < len(nodes):
                    segs.append((b"\1" if j < i else b"\2") + bytes.fromhex(nodes[j]))
                else:
                    segs.append(bytes(LINK))
            levels += [level + k] * len(nodes)
            places += range(base, base + len(nodes))
            nodes = [_h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        n = len(segs) + 1
        return pa.table({
            "gid": pa.array(np.full(n, gid)), "height": pa.array(np.full(n, height, np.int32)), "level": pa.array([*levels, level + up], pa.int32()),
            "idx": pa.array([*places, first >> up], pa.int64()), "seg": pa.array([*segs, None], pa.binary()),
            "digest": pa.array([None] * (n - 1) + [bytes.fromhex(nodes[0])], pa.binary()),
            "row": pa.concat_arrays([rows, pa.nulls(n - len(rows), rows.type)]),
        })

    return build


def _tree(leaves: DataFrame, tallest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of the trees over leaves (gid, height, idx, digest, row).

    links: a row a node below its root: gid, level, idx, row (of leaves), and seg, which
    side its sibling stands on and the sibling's digest. roots: gid, digest. A task builds
    STEP levels over a block of aligned leaves; blocks of block roots follow, so a tree of
    any size takes a few rounds.
    """
    schema = StructType.fromDDL("gid long, height int, level int, idx long, seg binary, digest binary").add("row", leaves.schema["row"].dataType)
    now, level, links, roots = leaves, 0, None, None
    while True:
        built = scratch.table(
            now.groupBy("gid", F.shiftright("idx", STEP).alias("block")).applyInArrow(_block(level), schema), "nodes"
        )
        link, tops = built.filter("seg IS NOT NULL").drop("digest"), built.filter("digest IS NOT NULL").drop("seg")
        done = tops.filter("level = height").select("gid", "digest")
        links, roots = (link, done) if links is None else (links.union(link), roots.union(done))
        level += STEP
        if level >= tallest:
            return links, roots
        now = tops.filter("level < height").select("gid", "height", "idx", "digest", "row")


def _jump(links: DataFrame, tallest: int, scratch: Scratch) -> DataFrame:
    """(gid, row, seg) of the leaves, seg from the leaf to its root.

    A node holds the segment towards an ancestor; the ancestor at distance d of node idx
    is idx >> d. Each self-join appends the ancestor's own segment, which doubles the
    distance. Of the next round's nodes only those at levels that are multiples of the
    new distance can still be asked for, so the rows shrink towards the leaves alone.
    A round's keys have at most 2^d nodes each; where few ancestors are left they are
    broadcast, their size counted first.
    """
    reach = 1
    while reach < tallest:
        far = links.filter(F.col("level") % (2 * reach) == reach).select(
            "gid", (F.col("level") - reach).alias("level"), F.col("idx").alias("up"), F.col("seg").alias("more")
        )
        near = links.filter(F.col("level") % (2 * reach) == 0).withColumn("up", F.shiftright("idx", reach))
        links = near.join(_bounded(far, 32 + LINK * reach), ["gid", "level", "up"], "left").select(
            "gid", "level", "idx", F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg"), "row"
        )
        reach *= 2
        if reach < tallest:
            links = scratch.table(links, "jumped")
    return links.filter("level = 0").select("gid", "row", "seg")


def prove(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf") -> DataFrame:
    """rows with `subroot`, `root` and `path`, all binary.

    The leaves of a group, in `order`, are paired until one node is left, a node without a
    partner is hashed alone; the groups' roots, in the order of `group`, are paired
    likewise. A group of one leaf has that leaf for its root, as one group has its root
    for all. path has LINK bytes a level, from the leaf up to the root: the side of the
    sibling (0: none) and its digest. Nulls come first in both orders and strings are
    compared as UTF-8 bytes; rows that are equal in `order` stand in the order of their
    digests; repeated rows are leaves of their own; an empty table gives no rows. Further
    columns of any name are kept.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    keys = {"_g": F.col(group)} | {f"_o{i}": F.col(c) for i, c in enumerate(order)} | {"_leaf": F.col(leaf)}
    held = rows.select(*[c.alias(k) for k, c in keys.items()], F.struct("*").alias("row"))
    placed = scratch.table(_placed(held, list(keys), scratch).select("_g", F.col("_leaf").alias("digest"), "row", "place"), "placed")
    counted = placed.groupBy("_g").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    groups = scratch.table(_placed(counted, ["_g"], scratch).withColumnRenamed("place", "gid"), "groups")
    names = rows.columns
    if groups.isEmpty():
        return rows.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "path")]).limit(0)
    n_groups, most = groups.agg(F.count("*"), F.max("n")).first()
    height = lambda n: (n - 1).bit_length()
    g = _bounded(groups.withColumn("height", _height(F.col("n"))).withColumnRenamed("_g", "_k"), 256)
    leaves = placed.join(g, F.col("_g").eqNullSafe(F.col("_k"))).select("gid", "height", (F.col("place") - F.col("first")).alias("idx"), "digest", "row")
    links, roots = _tree(leaves, height(most), scratch)
    upper = roots.select(
        F.lit(0).cast("long").alias("gid"), F.lit(height(n_groups)).alias("height"), F.col("gid").alias("idx"), "digest",
        F.struct("gid", F.col("digest").alias("subroot")).alias("row"),
    )
    top_links, top = _tree(upper, height(n_groups), scratch)
    root = bytes(top.first()["digest"])
    above = _jump(top_links, height(n_groups), scratch).select("row.*", F.col("seg").alias("more"))
    out = _jump(links, height(most), scratch).join(_bounded(scratch.table(above, "above"), 128 + LINK * height(n_groups)), "gid")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in names], "subroot", F.lit(root).alias("root"), F.concat("seg", "more").alias("path")
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and changed: the leaf after tampering, null where there is none.

    A row is tampered with where 7 divides the crc32 of its decimal doc_id: n_chars grows
    by one. A row without an n_chars stays as it is, and so does one without a doc_id.
    """
    key, chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    fields = lambda n: digest(key, F.col("source"), F.col("lang"), n, F.col("text"))
    hit = (F.crc32(key.cast("string").cast("binary")) % 7 == 0) & chars.isNotNull()
    return docs.select(
        key.alias("doc_id"), F.col("lang").cast("string").alias("lang"), fields(chars).alias("leaf"), F.when(hit, fields(chars + 1)).alias("changed")
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = lambda c: F.lower(F.hex(c))
    proved = prove(document_leaves(docs), "lang", ["doc_id"]).withColumn("folded", folded(F.coalesce("changed", "leaf"), "path"))
    return proved.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), siblings_sha256("path").alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


OP11_SQL = """
with recursive fields as (
  select doc_id, lang, n_chars, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as state,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail
  from documents),
leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when xor(state, 4294967295) % 7 = 0 then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as changed
  from fields),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves),
trees as (
  select lang, 0 as level, list(leaf order by pos) as nodes from placed group by lang
  union all
  select lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from trees where len(nodes) > 1),
subroots as (
  select lang, level as height, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as gid from trees where len(nodes) = 1),
tops as (
  select 0 as level, list(subroot order by gid) as nodes from subroots
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from tops where len(nodes) > 1),
steps as (
  select p.doc_id, p.lang, p.pos, t.level, (p.pos >> t.level) % 2 as odd, t.nodes[xor(p.pos >> t.level, 1) + 1] as sibling
  from placed p join trees t on p.lang is not distinct from t.lang where len(t.nodes) > 1
  union all
  select p.doc_id, p.lang, p.pos, s.height + t.level, (s.gid >> t.level) % 2, t.nodes[xor(s.gid >> t.level, 1) + 1]
  from placed p join subroots s on p.lang is not distinct from s.lang cross join tops t where len(t.nodes) > 1),
paths as (
  select lang, pos, list({'o': odd, 's': sibling} order by level) as path, coalesce(string_agg(sibling, '' order by level), '') as said from steps group by lang, pos),
folding as (
  select p.lang, p.pos, 0 as level, coalesce(changed, leaf) as h from placed p
  union all
  select f.lang, f.pos, level + 1, sha256(case when path[level + 1].s is null then h when path[level + 1].o = 1 then path[level + 1].s || h else h || path[level + 1].s end)
  from folding f join paths q on f.lang is not distinct from q.lang and f.pos = q.pos where level < len(path))
select p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.said, '')) as proof_sha256, f.h as folded_root, f.h = r.root as verified
from placed p join subroots s on p.lang is not distinct from s.lang cross join (select nodes[1] as root from tops where len(nodes) = 1) r
left join paths q on p.lang is not distinct from q.lang and p.pos = q.pos
join folding f on p.lang is not distinct from f.lang and p.pos = f.pos and f.level = coalesce(len(q.path), 0)"""
