"""Repeated byte strings across documents, by merging the Burrows-Wheeler transforms of shards.

A string of `length` bytes is read as `depth` wide symbols of `length / depth` bytes each,
so that a position's suffix is the chain of the symbols at its place, one symbol further,
and so on. A Spark task is a shard: it sorts the suffixes of the texts it holds by their
first `depth` symbols, once, and hands on its transform, the order of its suffixes, from
which the symbol before every suffix follows. Transforms of different tasks are merged
without comparing suffixes: starting from "all first shard's rows, then the second's, ...",
every round deals the rows of the current interleave, in order, into counted buckets by
their preceding symbol. After k rounds the interleave is sorted by the first k symbols; a
boundary between neighbours that first shows in round k means that they share k - 1
symbols. Neighbours without a boundary after `depth` rounds share `length` bytes: these
runs are the repeated intervals.

What has to meet is found first, without loss: every window of `length` bytes has an
anchor, its leftmost least hash of 64 bytes, so equal windows have equal anchors. Windows
whose anchor occurs once cannot repeat. Runs of windows with one anchor are cut out as
snippets; a snippet is known by 128 bits (its anchor's hash and its own), and copies of one
count as one, with weights. Snippets of equal anchors share a group, and a group's
transforms meet in one task. Anchors with too many snippets for that are spread over
groups; what each group found is then merged once more, by parts of the anchor's windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanetrack.llm import bytesets as B
from wanetrack.llm.scratch import Scratch, one_partition_each


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeat. hot: distinct snippets of one anchor that a group takes;
    anchors with more are spread over groups. group_bytes: snippet bytes of a group, about.
    shard_bytes: bytes of a transform, so its places are 16-bit. pool_bytes: snippets that a
    task holds before it hands on their transforms."""

    length: int = 200
    anchor: int = 64
    depth: int = 4
    shard_bytes: int = 1 << 15
    group_bytes: int = 1 << 20
    pool_bytes: int = 1 << 22
    hot: int = 256

    @property
    def symbol(self) -> int:
        return self.length // self.depth


# --- anchors -------------------------------------------------------------------------

RUNS = "rid long, key long, snippet long, los array<int>, wins int, at int"


def _runs(c: B.Chunk, p: Repeats) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, anchor hash, snippet hash, first window, windows, anchor's offset."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n, span = len(c.data), p.length - p.anchor + 1
    if n < p.length:
        return none
    pre = B.prefix(c.data)
    at = np.arange(n - p.anchor + 1)
    h = B.spans(pre, at, at + p.anchor)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    size = np.diff(c.offsets)
    wins = np.maximum(size - p.length + 1, 0)
    row = np.repeat(np.arange(len(size)), wins)
    if not len(row):
        return none
    first = np.concatenate([[0], np.cumsum(wins)[:-1]])
    pos = np.arange(len(row)) + np.repeat(c.offsets[:-1] - first, wins)
    best = (low[pos] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    lo, best, row = pos[heads], best[heads], row[heads]
    hi = pos[np.append(heads[1:], len(pos)) - 1]
    return row, h[best], B.spans(pre, lo, hi + p.length), lo - c.offsets[row], hi - lo + 1, best - lo


def window_runs(docs: DataFrame, p: Repeats) -> DataFrame:
    """docs: rid, text. One row a snippet of a text: a run of neighbouring windows that share their anchor.

    A text that holds a snippet several times, as periodic text does, has all places in los.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in B.chunks(batch.column(1)):
                row, key, snip, lo, wins, at = _runs(c, p)
                order = np.lexsort((lo, snip, key, row))
                row, key, snip, lo, wins, at = (x[order] for x in (row, key, snip, lo, wins, at))
                new = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (snip[1:] != snip[:-1])
                head = np.flatnonzero(np.concatenate([[True], new])) if len(row) else np.zeros(0, np.int64)
                los = pa.ListArray.from_arrays(
                    pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(lo.astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[c.lo + row[head]]), pa.array(key[head].view(np.int64)), pa.array(snip[head].view(np.int64)),
                     los, *(pa.array(x[head].astype(np.int32)) for x in (wins, at))],
                    names=["rid", "key", "snippet", "los", "wins", "at"],
                )

    return docs.mapInArrow(run, RUNS)


# --- transforms and their merge ------------------------------------------------------


@dataclass
class Shard:
    """Rows in suffix order. place: position of the suffix (-1: the empty one); before: the symbol before it (-1: none)."""

    place: np.ndarray
    before: np.ndarray


def deal(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^32, dealt into counted buckets by their low 16 bits, then by the high ones."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")  # a counting sort at this width
    if len(x) and int(x.max()) >> 16:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def suffix_order(symbol: np.ndarray, nxt: np.ndarray, depth: int) -> np.ndarray:
    """Places by the first `depth` symbols of their suffixes, by doubling. nxt: the place one symbol further (-1: none)."""
    rank, jump, known = _dense(symbol) + 1, nxt, 1
    while known < depth:
        rank = _dense(rank << 32 | np.where(jump >= 0, rank[jump] + 1, 0)) + 1
        jump = np.where(jump >= 0, jump[jump], -1)
        known *= 2
    return deal(rank)


def transform(order: np.ndarray, symbol: np.ndarray, nxt: np.ndarray) -> Shard:
    """The shard of places in suffix order; symbol: small numbers in the order of the symbols."""
    prev = np.full(len(order), -1, np.int64)
    prev[nxt[nxt >= 0]] = np.flatnonzero(nxt >= 0)
    ends = np.flatnonzero(nxt < 0)
    before = np.where(prev >= 0, symbol[prev], -1)
    return Shard(np.concatenate([np.full(len(ends), -1), order]), np.concatenate([symbol[ends], before[order]]))


def merge_shards(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: (places in merged suffix order, symbols shared with the row above).

    Places of later shards follow those of earlier ones. Shared symbols count up to
    `depth`; the empty suffixes come first and are left out.
    """
    n = [len(s.place) for s in shards]
    empty = [int((s.place < 0).sum()) for s in shards]
    head = np.repeat(np.arange(len(shards)), empty)
    inter = np.repeat(np.arange(len(shards)), n)
    lead = len(head)
    # Order of rows before any symbol is read: everything is one group.
    group = np.zeros(len(inter), np.int64)
    shared = np.full(len(inter), depth, np.int64)
    before = np.concatenate([s.before for s in shards])

    def rows_of(z: np.ndarray) -> np.ndarray:
        """The shard rows that an interleave stands for: each shard's rows in their own order."""
        out = np.empty(len(z), np.int64)
        out[deal(z)] = np.arange(len(z))
        return out

    for k in range(1, depth + 1):
        symbol = before[rows_of(inter)]
        src = np.flatnonzero(symbol >= 0)
        src = src[deal(symbol[src])]
        symbol = symbol[src]
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (group[src[1:]] != group[src[:-1]])])
        inter = np.concatenate([head, inter[src]])
        flags = np.concatenate([np.arange(lead) == 0, new])
        shared[flags & (shared == depth)] = k - 1
        group = np.cumsum(flags)
    assert len(inter) == sum(n)
    base = np.cumsum([0, *(a - b for a, b in zip(n, empty, strict=True))])
    place = np.concatenate([np.where(s.place < 0, -1, s.place + base[i]) for i, s in enumerate(shards)])
    return place[rows_of(inter)][lead:], shared[lead:]


def _places(data: np.ndarray, size: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one after the other: the wide symbol at each place that has one, and the place one symbol further."""
    step = p.symbol
    count = size - step + 1
    first = np.cumsum(count) - count
    place = np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - first, count)
    symbol = B.spans(B.prefix(data), place, place + step)
    nxt = np.arange(len(place)) + step
    return symbol, np.where(nxt < np.repeat(first + count, count), nxt, -1)


def merge_classes(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """(symbols, next places, suffix order) of every shard: the class of every place, equal where `depth` symbols are."""
    known = [s[o] for s, _, o in parts]  # a shard's first symbols, in order
    heads = [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in known]
    alphabet = np.unique(np.concatenate(heads))
    shards = [transform(o, np.searchsorted(alphabet, s), nxt) for s, nxt, o in parts]
    at, shared = merge_shards(shards, depth)
    cls = np.empty(len(at), np.int64)
    cls[at] = np.cumsum(shared < depth)
    return cls


# --- Spark ---------------------------------------------------------------------------

_FOUND = "key long, snippet long, spans array<struct<a:int,b:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_OFFSETS = 8


def _spans(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of set flags as first and last index."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_META = ("key", "snippet", "n", "m", "wins", "at")
_SHARDS = "grp long, meta binary, data binary, suffixes binary"


def _transforms(docs: DataFrame, reps: DataFrame, p: Repeats) -> DataFrame:
    """Cuts the representatives' bytes out of their texts and hands on each task's transforms, one row a shard.

    reps: rid and a list of what to cut. meta: six 64-bit numbers a snippet; data: their
    bytes; suffixes: the order of their places, 16 bits each.
    """

    def flush(rows: list[dict], raw: list[bytes]) -> pa.RecordBatch:
        grp = np.array([r["grp"] for r in rows], np.int64)
        order = np.argsort(grp, kind="stable")
        rows, raw, grp = [rows[i] for i in order], [raw[i] for i in order], grp[order]
        meta = np.array([[r[k] for k in _META] for r in rows], np.int64)
        size = np.array([len(x) for x in raw])
        end = np.cumsum(size)
        # A shard ends with its group, or before its bytes would be too many.
        new_group = np.concatenate([[True], grp[1:] != grp[:-1]])
        start = (end - size)[np.maximum.accumulate(np.where(new_group, np.arange(len(grp)), 0))]
        part = (end - 1 - start) // p.shard_bytes
        cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | new_group[1:]]))
        out = {k: [] for k in ("grp", "meta", "data", "suffixes")}
        for a, b in zip(cut, [*cut[1:], len(rows)], strict=True):
            data = b"".join(raw[a:b])
            symbol, nxt = _places(np.frombuffer(data, np.uint8), size[a:b], p)
            row = (int(grp[a]), meta[a:b].tobytes(), data, suffix_order(symbol, nxt, p.depth).astype(np.uint16).tobytes())
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, raw, held = [], [], 0
        for batch in batches:
            texts, cuts = batch.column(0).cast(pa.binary()), batch.column(1)
            for i in range(len(batch)):
                text = memoryview(texts[i].as_buffer())
                for r in cuts[i].as_py():
                    rows.append(r)
                    raw.append(bytes(text[r["lo"] : r["lo"] + r["wins"] - 1 + p.length]))
                    held += len(raw[-1])
                    if held >= p.pool_bytes:
                        yield flush(rows, raw)
                        rows, raw, held = [], [], 0
        if rows:
            yield flush(rows, raw)

    return docs.join(reps, "rid").select("text", "cuts").mapInArrow(run, _SHARDS)


def repeated_windows(docs: DataFrame, scratch: Scratch, p: Repeats) -> DataFrame:
    """docs: rid, text. Rows (rid, windows): of each range, the windows starting at bytes a to b of the text occur more than once."""
    runs = scratch.table(window_runs(docs, p), "runs")
    often = runs.groupBy("key").agg(F.sum(F.size("los")).alias("n")).filter("n > 1").select("key")
    often = scratch.table(often, "often")  # so that the join below is between plain exchanges, which Spark can split
    kept = scratch.table(runs.join(often, "key", "left_semi"), "kept")
    scratch.drop(runs, often)
    distinct = kept.groupBy("key", "snippet").agg(
        F.sum(F.size("los")).alias("n"), F.min(F.struct("rid", F.col("los")[0].alias("lo"), "wins", "at")).alias("rep")
    )
    distinct = scratch.table(distinct, "distinct")
    mixed = distinct.groupBy("key").agg(F.count("*").alias("m"))
    distinct = scratch.table(distinct.join(mixed, "key"), "weighed")

    # An anchor with one snippet has nothing to merge with: each of its windows occurs as often as the snippet.
    alone = distinct.filter("m = 1").select(
        "key", "snippet", F.array(F.struct(F.lit(0).alias("a"), (F.col("rep.wins") - 1).alias("b"))).alias("spans")
    )
    several = distinct.filter("m > 1")
    n_bytes = several.agg(F.coalesce(F.sum(F.col("rep.wins") - 1 + p.length), F.lit(0))).first()[0]
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // p.group_bytes))
    salt = F.when(F.col("m") > p.hot, F.pmod(F.col("snippet"), F.ceil(F.col("m") / p.hot))).otherwise(F.lit(0))
    grp = F.pmod(F.xxhash64("key", salt), F.lit(groups)).alias("grp")
    reps = several.groupBy(F.col("rep.rid").alias("rid")).agg(
        F.collect_list(F.struct(grp, "key", "snippet", "n", "m", "rep.lo", "rep.wins", "rep.at")).alias("cuts")
    )
    symbols = p.depth

    def merge(t: pa.Table) -> pa.Table:
        metas = [np.frombuffer(x.as_py(), np.int64).reshape(-1, len(_META)) for x in t.column("meta")]
        parts = []
        for meta, data, suffixes in zip(metas, t.column("data"), t.column("suffixes"), strict=True):
            size = meta[:, 4] - 1 + p.length
            symbol, nxt = _places(np.frombuffer(data.as_py(), np.uint8), size, p)
            parts.append((symbol, nxt, np.frombuffer(suffixes.as_py(), np.uint16).astype(np.int64)))
        every = merge_classes(parts, p.depth)
        key, snip, n, m, wins, at = np.concatenate(metas).T
        count = wins - 1 + p.length - p.symbol + 1
        first = np.cumsum(wins) - wins
        place = np.arange(wins.sum()) + np.repeat(np.cumsum(count) - count - first, wins)
        cls = every[place]
        weight = np.bincount(cls, np.repeat(np.minimum(n, 2), wins))
        flags = weight[cls] > 1
        out = {k: [] for k in ("key", "snippet", "spans", "part", "symbols", "suffixes", "owners", "offsets", "kinds", "weights")}

        def put(**row: object) -> None:
            for k, v in out.items():
                v.append(row.get(k))

        hot = m > p.hot
        for i in np.flatnonzero(~hot):
            if found := _spans(flags[first[i] : first[i] + wins[i]]):
                put(key=int(key[i]), snippet=int(snip[i]), spans=found)
        if hot.any():
            # Windows of spread anchors: texts of `depth` symbols, in parts by their offset from the anchor and first symbol.
            whole = np.concatenate([x[0] for x in parts])
            keep = np.repeat(hot, wins)
            own = np.repeat(np.arange(len(wins)), wins)[keep]
            off = (np.arange(len(cls)) - np.repeat(first, wins))[keep]
            where, kind = place[keep], cls[keep]
            chain = whole[where[:, None] + p.symbol * np.arange(symbols)]
            sub = (chain[:, 0] % (-(-m[own] // (16 * p.hot))).astype(np.uint64)).astype(np.int64)
            part = (at[own] - off) // _OFFSETS * (1 << 32) + sub
            order = np.lexsort((kind, part, key[own]))
            own, off, kind, part, chain = own[order], off[order], kind[order], part[order], chain[order]
            edge = np.flatnonzero(np.concatenate([[True], (key[own][1:] != key[own][:-1]) | (part[1:] != part[:-1])]))
            for a, b in zip(edge, [*edge[1:], len(own)], strict=True):
                one, at_class, size = np.unique(kind[a:b], return_index=True, return_counts=True)
                texts = chain[a:b][at_class]
                nxt = np.arange(texts.size) + 1
                nxt[symbols - 1 :: symbols] = -1
                put(
                    key=int(key[own[a]]), part=int(part[a]), symbols=texts.tobytes(),
                    suffixes=suffix_order(texts.ravel(), nxt, symbols).astype(np.int32).tobytes(),
                    owners=snip[own[a:b]].tobytes(), offsets=off[a:b].astype(np.int32).tobytes(),
                    kinds=np.repeat(np.arange(len(one)), size).astype(np.int32).tobytes(),
                    weights=np.minimum(weight[one], 2).astype(np.uint8).tobytes(),
                )
        return pa.table(
            [pa.array(out["key"], pa.int64()), pa.array(out["snippet"], pa.int64()), pa.array(out["spans"], _FOUND_TYPE),
             pa.array(out["part"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in list(out)[4:])],
            names=list(out),
        )

    merged = scratch.table(
        one_partition_each(
            _transforms(docs, reps, p), "grp", groups, merge,
            _FOUND + ", part long, symbols binary, suffixes binary, owners binary, offsets binary, kinds binary, weights binary",
        ),
        "merged",
    )

    def meet(t: pa.Table) -> pa.Table:
        column = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(c)]
        parts, texts = [], []
        for symbol, suffixes in zip(column("symbols", np.uint64), column("suffixes", np.int32), strict=True):
            nxt = np.arange(len(symbol)) + 1
            nxt[symbols - 1 :: symbols] = -1
            parts.append((symbol, nxt, suffixes.astype(np.int64)))
            texts.append(len(symbol) // symbols)
        cls = merge_classes(parts, symbols)[::symbols]
        weight = np.bincount(cls, np.concatenate(column("weights", np.uint8)))
        base = np.repeat(np.cumsum(texts) - texts, [len(x) for x in column("kinds", np.int32)])
        hit = np.flatnonzero(weight[cls[np.concatenate(column("kinds", np.int32)) + base]] > 1)
        own, off = np.concatenate(column("owners", np.int64))[hit], np.concatenate(column("offsets", np.int32))[hit]
        order = np.lexsort((off, own))
        o, x = own[order], off[order]
        edge = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1] + 1)])) if len(o) else []
        ends = [*edge[1:], len(o)] if len(o) else []
        key = t.column("key")[0].as_py()
        return pa.table(
            [pa.array([key] * len(edge), pa.int64()), pa.array([int(o[a]) for a in edge], pa.int64()),
             pa.array([[{"a": int(x[a]), "b": int(x[b - 1])}] for a, b in zip(edge, ends, strict=True)], _FOUND_TYPE)],
            names=["key", "snippet", "spans"],
        )

    spread = merged.filter("snippet is null").groupBy("key", "part").applyInArrow(meet, _FOUND)
    found = alone.union(merged.filter("snippet is not null").select("key", "snippet", "spans")).union(spread)
    out = (
        kept.select("rid", "key", "snippet", "los").distinct()
        .join(found, ["key", "snippet"])
        .select("rid", F.flatten(F.transform("los", lambda lo: F.transform("spans", lambda s: F.struct((lo + s["a"]).alias("a"), (lo + s["b"]).alias("b"))))).alias("windows"))
    )
    out = scratch.table(out, "windows")
    scratch.drop(kept, distinct, merged)
    return out


def _removed(n: int, windows: list[dict[str, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows."""
    out: list[tuple[int, int]] = []
    for w in sorted(windows, key=lambda w: (w["a"], w["b"])):
        a, b = w["a"], w["b"] + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    assert not out or out[-1][1] <= n
    return out


def remove_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """Removes every byte covered by a string of p.length bytes that also starts anywhere else.

    Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans
    (removed byte runs), kept_text (kept without the bytes of split characters) and row (a
    struct of the other columns). Strings are judged on the input, never cross documents, and
    all their occurrences go, overlapping ones in one document included. Null texts count
    as empty; texts shorter than p.length keep everything; a row that occurs twice is a
    repeat of itself; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), carried
    )
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    windows = repeated_windows(rows.select("rid", "text"), scratch, p)
    windows = windows.groupBy("rid").agg(F.flatten(F.collect_list("windows")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw = text.as_py()
                gone = _removed(len(raw), found.as_py() or [], p.length)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for c, v in zip(cols, (len(raw), sum(b - a for a, b in gone), len(gone), b"".join(kept), [{"a": a, "b": b} for a, b in gone],
                                          b"".join(k.decode("utf-8", "ignore").encode() for k in kept).decode()), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), _FOUND_TYPE, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), batch.column(3)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", "kept_text", "row"],
            )

    schema = T.StructType.fromDDL(
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<a:int,b:int>>, kept_text string"
    ).add("row", rows.schema["row"].dataType)
    return rows.join(windows, "rid", "left").select("doc_id", "text", "windows", "row").mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """docs with repeated passages cut out of the texts; bytes of a character that a cut splits go with it.

    Every row stays. A column n_chars, where there is one, is counted anew.
    """
    text = F.col("kept_text")
    return remove_repeats(docs, p).select(
        *[
            text.alias(c) if c == "text"
            else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col("row").getField(c).alias(c)
            for c in docs.columns
        ]
    )


def op3_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
