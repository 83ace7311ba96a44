"""Near-duplicate documents: MinHash bands, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wanetrack.llm import bytesets as B
from wanetrack.llm.components import connected_components, settle_buckets
from wanetrack.llm.scratch import Scratch


@dataclass(frozen=True)
class NearDup:
    """Similarity is intersection over union of distinct word shingles, linked from percent / 100 on.

    At similarity 0.8 a pair shares none of 32 bands of 4 minima with probability
    (1 - 0.8^4)^32 = 4.5e-8. A pair whose signatures agree in fewer than `screen` of the
    minima (7 standard deviations below 0.8) goes no further; all others are compared exactly.
    """

    shingle_words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    seed: int = 17
    rounds: int = 2
    block: int = 512

    @property
    def n_hashes(self) -> int:
        return self.bands * self.rows

    @property
    def screen(self) -> int:
        p = self.percent / 100
        return max(1, int(self.n_hashes * (p - 7 * (p * (1 - p) / self.n_hashes) ** 0.5)))

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 31, self.n_hashes, np.uint32) * np.uint32(2) + np.uint32(1)
        return a, rng.integers(0, 1 << 32, self.n_hashes, np.uint32)


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, signature binary, bands array<long>"


def _signatures(x: np.ndarray, rows: np.ndarray, p: NearDup) -> np.ndarray:
    """Minima of universal hashes for each row that has shingles: rows x n_hashes."""
    heads = rows[:-1][np.diff(rows) > 0]
    out = np.empty((len(heads), p.n_hashes), np.uint32)
    if len(heads):
        x32 = (x >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(x32)
        for j, (a, b) in enumerate(zip(*p.coefficients(), strict=True)):
            np.multiply(x32, a, out=v)
            v += b
            out[:, j] = np.minimum.reduceat(v, heads)
    return out


def _bands(sig: np.ndarray, p: NearDup) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands never share keys by design of the salt."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), p.bands, p.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64) * B._STEP[6], parts.shape[:2]).copy()
        for r in range(p.rows):
            h = B.mix(h ^ (parts[:, :, r] * B._STEP[r] + B._STEP[7]))
    return h.astype(np.int64)


def sketch(docs: DataFrame, p: NearDup) -> DataFrame:
    """One row a document: shingle count, a 128-bit key of its shingle set, signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(1)):
                w = B.words(c)
                x, rows = B.shingles(B.word_hashes(c, w), w.rows, p.shingle_words)
                sets = [np.unique(x[a:b]) for a, b in zip(rows, rows[1:], strict=False)]
                n = np.array([len(s) for s in sets], np.int64)
                x = np.concatenate(sets) if sets else x
                rows = np.concatenate([[0], np.cumsum(n)])
                some = n > 0
                sig = _signatures(x, rows, p)
                keys = np.zeros((2, len(n)), np.uint64)
                if some.any():
                    heads = rows[:-1][some]
                    keys[0, some] = np.add.reduceat(B.mix(x ^ B._STEP[1]), heads)
                    keys[1, some] = np.add.reduceat(B.mix(x ^ B._STEP[2]), heads)
                bands, at = iter(_bands(sig, p)), iter(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.lo, c.hi - c.lo),
                        pa.array(n),
                        *(pa.array(k.view(np.int64)) for k in keys),
                        pa.array([next(at).tobytes() if s else b"" for s in some], pa.binary()),
                        pa.array([next(bands) if s else [] for s in some], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "signature", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _sets(column: pa.Array, p: NearDup) -> list[np.ndarray]:
    """The distinct shingles of every text, sorted."""
    out = []
    for c in B.chunks(column):
        w = B.words(c)
        x, rows = B.shingles(B.word_hashes(c, w), w.rows, p.shingle_words)
        out += [np.unique(x[a:b]) for a, b in zip(rows, rows[1:], strict=False)]
    return out


def _screened(pairs: DataFrame, sketches: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (u, v) whose signatures agree often enough to go on."""
    side = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s{c}"))
    need = p.screen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, p.n_hashes) for i in (2, 3)
            )
            keep = pa.array((a == b).sum(1) >= need)
            yield batch.select(["u", "v"]).filter(keep)

    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv")
    return both.mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """Pairs whose full shingle sets are similar enough. texts: doc_id, text, one row an id."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                keep = []
                for a, b in zip(_sets(batch.column(2), p), _sets(batch.column(3), p), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= p.percent * (len(a) + len(b) - both))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv")
    return both.mapInArrow(run, "u long, v long")


def _compared(opened: DataFrame, texts: DataFrame, scratch: Scratch, p: NearDup) -> DataFrame:
    """opened: bucket (a band), n, node, part. Similar pairs (u, v) of equal band and different part.

    The members of a band are dealt into blocks, and every two blocks meet in a task of
    their own, which counts common shingles as a product of incidence matrices. So a task
    holds two blocks, whatever the band's size, and only links leave it, not pairs. A pair
    is taken up at its least common open band alone.
    """
    bands = opened.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list("bucket").alias("bands"))  # p.bands at most

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([x.tobytes() for x in _sets(batch.column(1), p)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["doc_id", "shingles"])

    sets = scratch.table(
        texts.join(bands.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(shingle_sets, "doc_id long, shingles binary"),
        "sets",
    )
    rows = opened.select("bucket", F.col("node").alias("doc_id"), "part", F.ceil(F.col("n") / p.block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "part"
    )

    def compare(t: pa.Table) -> pa.Table:
        ids, part = t.column("doc_id").to_numpy(), t.column("part").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
        size = np.array([len(x) for x in sets])
        band = t.column("bucket")[0].as_py()
        earlier = B.common_counts([x[x < band] for x in (np.unique(np.array(m.as_py(), np.int64)) for m in t.column("bands"))])
        both = B.common_counts(sets)
        union = size[:, None] + size[None, :] - both
        a, b = np.nonzero((100 * both >= p.percent * union) & (earlier == 0) & (part[:, None] != part[None, :]) & (ids[:, None] > ids[None, :]))
        return pa.table([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["u", "v"])

    return met.join(sets, "doc_id").join(bands, "doc_id").groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Documents with equal shingle sets form a class, represented by its least doc_id; only
    representatives are banded. In every band bucket members are compared with a pivot,
    in p.rounds rounds with another one each, unless both are of one component already.
    Buckets that then still hold several components are compared in bounded blocks, so no
    link that the bands find is lost, and no pair leaves a task unless it is a link. Every
    link is confirmed on full sets.

    A document without words (null, empty or blank text) links with nothing; one with
    fewer words than a shingle has its whole sequence as the only one. Rows that repeat
    a doc_id are put out as often as they occur and count as one document: it is linked
    with all that any of its texts with words is linked with. A row without a doc_id has
    its group's component_id, if the group has an id at all, and no kept. An empty table
    gives no rows. Other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = scratch.table(sketch(docs, p), "sketches")
    set_key = ["n_shingles", "k1", "k2"]
    classes = scratch.table(
        rows.filter("n_shingles > 0").groupBy(*set_key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")),
        "classes",
    )
    reps = scratch.table(
        rows.join(classes.select(F.col("rep").alias("doc_id"), *set_key), ["doc_id", *set_key], "left_semi")
        .dropDuplicates(["doc_id", *set_key]),
        "reps",
    )
    banded = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    shared = scratch.table(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "buckets")
    members = scratch.table(banded.join(shared, "bucket"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, parts = settle_buckets(
        members, scratch, p.rounds,
        lambda pairs: _confirmed(scratch.table(_screened(pairs, reps, p).distinct(), "screened"), texts, p).distinct(),
        lambda opened: _compared(opened, texts, scratch, p).distinct(),
    )
    if parts is None:
        parts = docs.sparkSession.createDataFrame([], "u long, v long")
    # Ids that run with several texts tie their classes together.
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct(*set_key)).alias("a"), F.max(F.struct(*set_key)).alias("b")
    )
    several = scratch.table(several.filter("a < b").select("doc_id"), "several")
    if not several.isEmpty():
        ties = rows.join(several, "doc_id").join(classes, set_key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        parts = connected_components(parts.union(ties), scratch)

    by_rep = classes.join(parts.select(F.col("u").alias("rep"), F.col("v").alias("part")), "rep", "left").select(
        *set_key, F.coalesce("part", "rep").alias("part")
    )
    out = rows.select("doc_id", *set_key).join(by_rep, set_key, "left")
    if not several.isEmpty():  # also the rows of such an id that have no words
        whole = parts.join(several.select(F.col("doc_id").alias("u")), "u").select(F.col("u").alias("doc_id"), F.col("v").alias("whole"))
        out = out.join(whole, "doc_id", "left").withColumn("part", F.coalesce("part", "whole"))
    return out.select("doc_id", "n_shingles", F.coalesce("part", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )


def keep_one(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """The rows of docs, with all their columns, that represent their group of near copies: one row a group.

    Groups are of texts: rows that share a doc_id but not the text are different
    documents here. Of a group the least doc_id stays that only one row of docs has; where
    all its ids are repeated ones, the row with the least checksum of id and text; and
    among rows equal in both, the one with the least checksum of all columns. Rows without words stay (once, where id and text are equal).
    Rows without a doc_id cannot be named in a group and stay. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "keepone")
    rows = docs.select(F.struct("*").alias("row")).withColumn("rid", F.col("row.doc_id").cast("long"))
    ids = rows.filter("rid IS NOT NULL").groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = scratch.table(ids.select("rid", F.lit(True).alias("repeated")), "repeated")
    again = not repeated.isEmpty()
    if again:
        # Ids from 2^62 on stand for (id, text); no real id should lie there.
        own = F.xxhash64("rid", "row.text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        rows = rows.join(repeated, "rid", "left").withColumn("rid", F.when(F.col("repeated"), own).otherwise(F.col("rid")))
    groups = near_duplicates(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), p)
    copies = scratch.table(groups.filter("not kept").select(F.col("doc_id").alias("rid")).distinct(), "copies")
    out = rows.join(copies, "rid", "left_anti")
    if again:
        nth = F.row_number().over(Window.partitionBy("rid").orderBy(F.xxhash64("row")))
        out = out.filter("repeated IS NULL").select("row").union(
            out.filter("repeated").withColumn("nth", nth).filter("nth = 1").select("row")
        )
    return out.select("row.*")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), NearDup(shingle_words=4))


OP2_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s
  from words),
items as (select doc_id, unnest(s) as x from sets),
shared as (
  select a.doc_id as u, b.doc_id as v, count(*) as n
  from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (
  select u, v from shared join sets a on a.doc_id = u join sets b on b.doc_id = v
  where 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
both_ways as (select u, v from links union select v, u from links),
reach as (
  select doc_id, doc_id as r from sets
  union
  select reach.doc_id, both_ways.v from reach join both_ways on both_ways.u = reach.r)
select sets.doc_id, cast(len(s) as bigint) as n_shingles, min(r) as component_id, sets.doc_id = min(r) as kept
from sets join reach using (doc_id) group by sets.doc_id, len(s)
"""
