"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm import bytesets as B
from wanetrack.llm.components import connected_components, settle_buckets
from wanetrack.llm.scratch import Scratch


@dataclass(frozen=True)
class Audio:
    """Recordings are unsigned 8-bit mono PCM, or scores: bytes 0 to 11 are the pitch class of each beat.

    A frame spans `frame` samples (beats), the next begins `hop` later, and an item spans
    `width` frames; shorter recordings are followed by silence.
    agree: the part of the items in the overlap that must be equal at one offset.
    least: equal items that are needed, or that part of the longer recording's items if that is fewer.
    max_error: the largest part of differing bits over the overlap.
    Two of the equal items must be neighbours, unless both recordings have five items or
    fewer: pairs of items are keys of 64 bits, which few unrelated recordings share, however
    many there are; single items of 32 bits are shared by all at some size of the corpus.
    rounds, few, block: see link_recordings(); they change the work, never the result.
    """

    score: bool = False

    rate: int = 8000
    frame: int = 256
    hop: int = 64
    low_hz: float = 220.0
    high_hz: float = 3900.0
    width: int = 8
    agree: float = 0.2
    least: int = 8
    max_error: float = 0.15
    rounds: int = 3
    few: int = 16
    block: int = 256

    @property
    def silence(self) -> int:
        return 12 if self.score else 128

    @property
    def reach(self) -> int:
        return self.frame + (self.width - 1) * self.hop

    def enough(self, longer: np.ndarray | int) -> np.ndarray:
        """Equal items that a pair needs at least."""
        return np.minimum(self.least, self.agree * longer)

    def linked(self, longer: int, found: Alignment) -> bool:
        return bool(
            found.equal >= max(self.enough(longer), self.agree * found.overlap)
            and found.errors <= self.max_error * 32 * found.overlap
            and (found.neighbours or longer <= 5)
        )


def pitch_classes(p: Audio) -> np.ndarray:
    """Spectrum bins x 12: the class of each bin's nearest semitone, for bins within the band."""
    hz = np.fft.rfftfreq(p.frame, 1 / p.rate)
    out = np.zeros((len(hz), 12), np.float32)
    inside = np.flatnonzero((hz >= p.low_hz) & (hz <= p.high_hz))
    out[inside, np.round(12 * np.log2(hz[inside] / 440.0)).astype(int) % 12] = 1
    return out


def filters(p: Audio) -> list[tuple[int, int, int, int]]:
    """Sixteen (shape, first class, classes, frames) by rule: four shapes at four places and sizes."""
    return [(s, (3 * k + 2 * s) % (12 - h + 1), h, p.width >> (k % 2)) for k in range(4) for s in range(4) for h in [(4, 6, 8, 10)[(k + s) % 4]]]


def frames(data: np.ndarray, starts: np.ndarray, p: Audio) -> np.ndarray:
    """Pitch-class energies of the frames that begin at `starts`, each of unit length (silence: zero)."""
    window = np.hanning(p.frame + 2)[1:-1].astype(np.float32)
    if p.score:
        out = np.zeros((len(starts), 13), np.float32)
        row = np.arange(len(starts))
        for k in range(p.frame):
            out[row, data[starts + k]] += window[k]
        return _unit(out[:, :12])
    classes = pitch_classes(p)
    out = np.empty((len(starts), 12), np.float32)
    at = np.arange(p.frame)
    for lo in range(0, len(starts), 4096):
        x = data[starts[lo : lo + 4096, None] + at].astype(np.float32)
        x -= x.mean(1, keepdims=True)
        s = np.fft.rfft(x * window)
        out[lo : lo + 4096] = (s.real**2 + s.imag**2).astype(np.float32) @ classes
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 1e-3, norm, np.inf)


def items(chroma: np.ndarray, starts: np.ndarray, p: Audio) -> np.ndarray:
    """One packed 32-bit item a start: 16 filter responses of two bits, Gray-coded, from an integral image."""
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(chroma, axis=0, dtype=np.float64), axis=1)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = image[starts + t], image[starts + t + w]
        return b[:, y + h] - b[:, y] - a[:, y + h] + a[:, y]

    out = np.zeros(len(starts), np.uint32)
    for shape, y, h, w in filters(p):
        whole = area(0, w, y, h)
        if shape == 0:  # later against earlier
            part = area(w // 2, w - w // 2, y, h)
        elif shape == 1:  # upper against lower classes
            part = area(0, w, y + h // 2, h - h // 2)
        elif shape == 2:  # two opposite quarters against the others
            part = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
        else:  # the middle third of the classes against the rest, scaled to equal size
            third = max(h // 3, 1)
            part = area(0, w, y + third, third)
            part, whole = part * (h - third), part * (h - third) + (whole - part) * third
        v = np.log1p(part) - np.log1p(whole - part)
        level = (v > -0.15).astype(np.uint32) + (v > 0.0) + (v > 0.15)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprint_chunk(c: B.Chunk, p: Audio) -> tuple[np.ndarray, np.ndarray]:
    """Items of each recording of a chunk, and the recordings' ranges; empty recordings have none."""
    n = np.diff(c.offsets)
    size = np.where(n > 0, np.maximum(n, p.reach), 0)
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.full(off[-1], p.silence, np.uint8)
    data[np.arange(len(c.data)) + np.repeat(off[:-1] - c.offsets[:-1], n)] = c.data
    n_frames = np.where(size > 0, (size - p.frame) // p.hop + 1, 0)
    f_off = np.concatenate([[0], np.cumsum(n_frames)])
    starts = np.repeat(off[:-1] - p.hop * f_off[:-1], n_frames) + p.hop * np.arange(f_off[-1])
    chroma = frames(data, starts, p)
    n_items = np.maximum(n_frames - p.width + 1, 0)
    i_off = np.concatenate([[0], np.cumsum(n_items)])
    at = np.repeat(f_off[:-1] - i_off[:-1], n_items) + np.arange(i_off[-1])
    return items(chroma, at, p), i_off


PRINTS = "rec_id long, n_items long, k1 long, k2 long, items binary"


def fingerprints(recordings: DataFrame, p: Audio = Audio()) -> DataFrame:
    """recordings: rec_id and pcm (binary). Items are little-endian uint32; k1, k2 are a key of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(1)):
                x, off = fingerprint_chunk(c, p)
                raw = x.astype("<u4").tobytes()
                packed = [raw[4 * a : 4 * b] for a, b in zip(off, off[1:], strict=False)]
                keys = np.zeros((2, c.hi - c.lo), np.uint64)
                some = np.diff(off) > 0
                if some.any():
                    place = (np.arange(len(x)) - np.repeat(off[:-1], np.diff(off))).astype(np.uint64)
                    for k in range(2):
                        h = B.mix((x.astype(np.uint64) << np.uint64(32) | place) * B._STEP[2 * k] + B._STEP[2 * k + 1])
                        keys[k, some] = np.add.reduceat(h, off[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(off)),
                     *(pa.array(k.view(np.int64)) for k in keys), pa.array(packed, pa.binary())],
                    names=["rec_id", "n_items", "k1", "k2", "items"],
                )

    return recordings.select(F.col("rec_id").cast("long"), F.col("pcm").cast("binary")).mapInArrow(run, PRINTS)


def landmarks(x: np.ndarray, least: int = 6) -> np.ndarray:
    """64-bit keys of a recording's neighbouring item pairs; those of fewer than `least` items give their single items too."""
    y = x.astype(np.uint64)
    out = [B.mix((y[:-1] << np.uint64(32) | y[1:]) ^ B._STEP[5])]
    if len(x) < least:
        out.append(B.mix(y ^ B._STEP[6]))
    return np.unique(np.concatenate(out))


def item_set(x: np.ndarray) -> np.ndarray:
    """An item with its number among equal items of its recording, as one sorted key each."""
    s = np.sort(x.astype(np.uint64))
    new = np.concatenate([[True], s[1:] != s[:-1]])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return s << np.uint64(32) | nth.astype(np.uint64)


def _holders(prints: DataFrame) -> DataFrame:
    """(bucket, node): the landmarks of every recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                found = [landmarks(np.frombuffer(raw, "<u4")).view(np.int64) for raw in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), ids], names=["bucket", "node"])

    return prints.select("rec_id", "items").mapInArrow(run, "bucket long, node long")


class Alignment(NamedTuple):
    """Place of b in a, equal items, overlap, differing bits there, and whether two equal items are neighbours."""

    offset: int
    equal: int
    overlap: int
    errors: int
    neighbours: bool


def align(a: np.ndarray, b: np.ndarray) -> Alignment:
    """The alignment at the peak of the offset histogram; ties go to the least offset, no equal item gives zeros."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b, a, "left", sorter=order), np.searchsorted(b, a, "right", sorter=order)
    n = hi - lo
    if not n.any():
        return Alignment(0, 0, 0, 0, False)
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    votes = np.bincount(i - j + len(b) - 1)
    off = int(votes.argmax()) - len(b) + 1
    x, y = a[max(off, 0) :], b[max(-off, 0) :]
    m = min(len(x), len(y))
    differ = x[:m] ^ y[:m]
    same = differ == 0
    return Alignment(off, int(votes.max()), m, int(np.bitwise_count(differ).sum()), bool((same[1:] & same[:-1]).any()))


LINKS = "u long, v long, offset long, equal_items long, overlap long, bit_errors long"


def _link_table(rows: list[tuple[int, ...]]) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [[]] * 6)]


_NAMES = [c.split()[0] for c in LINKS.split(", ")]


def _aligned(pairs: DataFrame, prints: DataFrame, p: Audio) -> DataFrame:
    """The pairs (u, v) that the rule links, with v's place in u."""
    side = lambda c: prints.select(F.col("rec_id").alias(c), F.col("items").alias(f"i{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, v, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                found = align(x, y)
                if p.linked(max(len(x), len(y)), found):
                    rows.append((u, v, *found[:4]))
            yield pa.RecordBatch.from_arrays(_link_table(rows), names=_NAMES)

    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "iu", "iv")
    return both.mapInArrow(run, LINKS)


def _aligned_in_blocks(opened: DataFrame, prints: DataFrame, p: Audio) -> DataFrame:
    """opened: bucket (a landmark), blocks, node, part. Linked pairs of one bucket and different parts.

    Holders of a mark are dealt into blocks, and every two blocks meet in a task of their
    own, which counts common items as a product of incidence matrices and aligns only
    pairs with enough. A pair is taken up at its least common open landmark alone.
    """
    marks = opened.groupBy("node").agg(F.collect_list("bucket").alias("marks"))  # no more than the recording's landmarks
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = opened.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part")
    met = dealt.join(prints.select(F.col("rec_id").alias("node"), "items").join(marks, "node"), "node")

    def compare(t: pa.Table) -> pa.Table:
        mark = t.column("bucket")[0].as_py()
        ids, part, own = (t.column(c).to_numpy() for c in ("node", "part", "own"))
        items = [np.frombuffer(x.as_py(), "<u4") for x in t.column("items")]
        earlier = [x[x < mark] for x in (np.array(m.as_py(), np.int64) for m in t.column("marks"))]
        size = np.array([len(x) for x in items])
        wanted = (ids[:, None] > ids[None, :]) & (part[:, None] != part[None, :])
        if (own != own[0]).any():
            wanted &= own[:, None] != own[None, :]
        elif t.column("i")[0] != t.column("j")[0]:
            wanted[:] = False
        wanted &= B.common_counts(earlier) == 0
        wanted &= B.common_counts([item_set(x) for x in items]) >= p.enough(np.maximum(size[:, None], size[None, :]))
        rows = []
        for a, b in zip(*np.nonzero(wanted), strict=True):
            found = align(items[a], items[b])
            if p.linked(max(size[a], size[b]), found):
                rows.append((ids[a], ids[b], *found[:4]))
        return pa.table(_link_table(rows), names=_NAMES)

    return met.groupBy("bucket", "i", "j").applyInArrow(compare, LINKS)


def link_recordings(prints: DataFrame, scratch: Scratch, p: Audio = Audio()) -> tuple[DataFrame, DataFrame]:
    """(links, parts) of different recordings: alignments enough to know all classes, and the classes themselves.

    prints: rec_id, items (not empty), one row an id. parts has rows (u, v), v the least
    recording that u is linked with, over any number of links; only other recordings than
    v itself are in it. No pair is lost: recordings of a link share a landmark. In
    `rounds`, holders of a landmark are aligned with one of them, a pivot that changes by
    round, unless both are of one class already. Landmarks whose holders still are of
    several classes end the search: up to `few` holders meet in pairs, more in blocks.
    """
    holders = _holders(prints)
    shared = scratch.table(holders.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    members = scratch.table(holders.join(shared, "bucket"), "members")

    def in_open_buckets(opened: DataFrame) -> DataFrame:
        small = opened.filter(F.col("n") <= p.few)
        other = small.select("bucket", F.col("node").alias("v"), F.col("part").alias("with"))
        pairs = small.join(other, "bucket").filter("node > v AND part <> with").select(F.col("node").alias("u"), "v")
        found = _aligned(scratch.table(pairs.distinct(), "pairs"), prints, p)
        large = opened.filter(F.col("n") > p.few).withColumn("blocks", F.ceil(F.col("n") / p.block).cast("int"))
        return found.union(_aligned_in_blocks(large.drop("n"), prints, p)).distinct()

    links, parts = settle_buckets(members, scratch, p.rounds, lambda pairs: _aligned(pairs, prints, p), in_open_buckets)
    if links is None:
        spark = prints.sparkSession
        return spark.createDataFrame([], LINKS), spark.createDataFrame([], "u long, v long")
    return links, parts


def match_recordings(recordings: DataFrame, p: Audio = Audio()) -> DataFrame:
    """Per recording: rec_id, n_items, items_crc32, copy_of, class_id, kept and an alignment with another of its class.

    copy_of: the least rec_id with equal items. class_id: the least rec_id reachable over
    links, whose rule is that of Audio; kept: whether that is the recording itself. The
    alignment (match_id, match_offset, match_equal_items, match_overlap, match_bit_errors)
    is that of copy_of with a recording that it was found to be linked with: the most
    equal items, ties by least id. Null and empty recordings have no items and are alone;
    silence has items and matches silence; a null rec_id has no class, but its items
    count; repeated rows are put out as often as they occur, and rows that share a rec_id
    are of one class; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(recordings.sparkSession, "chroma")
    prints = scratch.table(fingerprints(recordings.select("rec_id", "pcm"), p), "prints")
    key = ["n_items", "k1", "k2"]
    named = prints.filter("n_items > 0 AND rec_id IS NOT NULL")
    classes = scratch.table(named.groupBy(*key).agg(F.min("rec_id").alias("copy_of"), F.first("items").alias("items")), "classes")
    # A recording stands for its items; ids under which several recordings run are tied together afterwards.
    reps = classes.select(F.xxhash64(*key).alias("rec_id"), "items")
    links, parts = link_recordings(reps, scratch, p)
    known = classes.select(*key, "copy_of", F.xxhash64(*key).alias("node"))
    several = named.groupBy("rec_id").agg(F.min(F.xxhash64(*key)).alias("v"), F.max(F.xxhash64(*key)).alias("w")).filter("v < w")
    ties = scratch.table(named.join(several, "rec_id").select(F.xxhash64(*key).alias("u"), "v").filter("u <> v").distinct(), "ties")
    if not ties.isEmpty():
        parts = connected_components(parts.union(ties), scratch)
    known = known.join(parts.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left")
    known = scratch.table(known.withColumn("part", F.coalesce("part", "node")), "known")
    least = known.groupBy("part").agg(F.min("copy_of").alias("class_id"))
    there = links.select(F.col("u").alias("node"), F.col("v").alias("other"), "offset", "equal_items", "overlap", "bit_errors")
    back = links.select("v", "u", -F.col("offset"), "equal_items", "overlap", "bit_errors")
    named_other = there.union(back).join(known.select(F.col("node").alias("other"), F.col("copy_of").alias("match_id")), "other")
    best = named_other.groupBy("node").agg(
        F.max(F.struct("equal_items", (-F.col("match_id")).alias("o"), "offset", "overlap", "bit_errors")).alias("best")
    )
    told = known.join(least, "part").join(best, "node", "left").select(*key, "copy_of", "class_id", "best")
    return prints.join(told, key, "left").select(
        "rec_id", "n_items", F.crc32("items").alias("items_crc32"),
        F.when(F.col("rec_id").isNotNull(), F.coalesce("copy_of", "rec_id")).alias("copy_of"),
        F.when(F.col("rec_id").isNotNull(), F.coalesce("class_id", "rec_id")).alias("class_id"),
        (F.col("rec_id") == F.coalesce("class_id", "rec_id")).alias("kept"),
        (-F.col("best.o")).alias("match_id"), F.col("best.offset").alias("match_offset"),
        F.col("best.equal_items").alias("match_equal_items"), F.col("best.overlap").alias("match_overlap"),
        F.col("best.bit_errors").alias("match_bit_errors"),
    )


#: For texts read as scores: a beat a word, so an edited word changes a few frames a little.
SCORES = Audio(score=True, frame=32, hop=8)


def text_scores(docs: DataFrame) -> DataFrame:
    """rec_id and pcm: every word of a document sounds for one beat, its hash choosing the pitch class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(1)):
                w = B.words(c)
                beats = ((B.word_hashes(c, w) >> np.uint64(40)) % np.uint64(12)).astype(np.uint8).tobytes()
                out = [beats[a:b] for a, b in zip(w.rows, w.rows[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(out, pa.binary())], names=["rec_id", "pcm"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "rec_id long, pcm binary")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so documents are rendered as scores; all of them are aligned with all others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return match_recordings(text_scores(docs), SCORES).withColumnRenamed("rec_id", "doc_id")
