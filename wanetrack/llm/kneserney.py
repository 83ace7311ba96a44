"""Interpolated modified Kneser-Ney bigram model: counted in Spark, memory-mapped for scoring."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm import bytesets as B
from wanetrack.llm.labelled import held_out
from wanetrack.llm.scratch import Scratch, local_path

#: Hashes of the end token and of the context before a text's first word; no word is likely to share them.
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
#: Tokens that a counting task aggregates before it hands them on.
POOL_TOKENS = 2_000_000
#: Bytes of packed bigrams that a shard takes. Texts give about as many packed bytes as they have.
SHARD_BYTES = 16 << 20
#: Reduce tasks and groups of files at most; each takes a run of shards, one in memory at a time.
GROUPS = 8192
#: Contexts that are counted in many shards because they follow each other too often for one.
HOT_CONTEXTS = 512


@dataclass(frozen=True)
class Model:
    """Where the sorted arrays lie, and the corpus totals. Its size is bounded by GROUPS and HOT_CONTEXTS.

    per_group: consecutive shards whose arrays lie in one file.
    written: the groups of bigrams and contexts, and those of words, that have files.
    """

    folder: str
    shards: int
    per_group: int = 1
    written: frozenset[str] = frozenset()
    tokens: int = 0
    vocabulary: int = 0
    bigram_types: int = 0
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    word_discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    word_backoff: float = 1.0
    hot: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return B.mix(u * B._STEP[0] + w * B._STEP[1])


def _slot(h: np.ndarray, shards: int) -> np.ndarray:
    """The range of hashes that each falls in; ranges are equal, so a sorted array is cut into runs."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _tokens(c: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token hashes of a chunk, and the rows' ranges; each row closes with the end token."""
    w = B.words(c)
    h = B.word_hashes(c, w)
    n = np.diff(w.rows)
    rows = np.concatenate([[0], np.cumsum(n + 1)])
    token = np.empty(rows[-1], np.uint64)
    token[rows[1:] - 1] = END
    token[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[rows[:-1]] = START
    return context, token, rows


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, a place of each in the input, and sums of values by key."""
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], heads) if len(key) else v[:0] for v in values]
    return key[heads], order[heads], sums


def _shard_of(u: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    at = np.searchsorted(hot, u)
    is_hot = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == u) if len(hot) else np.zeros(len(u), bool)
    return np.where(is_hot, _slot(w, shards), _slot(u, shards))


def _hot_contexts(docs: DataFrame, shards: int, fraction: float = 0.02) -> np.ndarray:
    """Contexts seen often in a sample. They only steer where counts are added up, never the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(0), 1 << 23):
                u, _, _ = _tokens(c)
                h, _, (n,) = _summed(u, np.ones(len(u), np.int64))
                top = np.argsort(-n)[:4096]
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top])], names=["h", "n"])

    seen = docs.sample(fraction, 7).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.desc("n"), "h").limit(HOT_CONTEXTS).collect()
    return np.sort(np.array([r[0] for r in rows] + [START.view(np.int64)], np.int64).view(np.uint64))


#: Arrays of a group's files and the numbers that an entry takes; the offsets of a value array are those of its keys.
_PAIRS = {"once": ("once", 1), "more": ("more", 1), "more_n": ("more", 1), "context": ("context", 1), "context_n": ("context", 4)}
_WORDS = {"word": ("word", 1), "word_n": ("word", 2)}


class _GroupFiles:
    """One group's arrays, appended shard by shard, and where each shard's entries begin.

    A task that runs twice writes the same bytes; renaming makes either whole, the index last.
    """

    def __init__(self, folder: str, label: str, kinds: dict[str, tuple[str, int]], group: int, per_group: int):
        self.folder, self.label, self.group, self.kinds, self.mark = folder, label, group, kinds, uuid.uuid4().hex
        self.files = {k: open(self._path(k, self.mark), "wb") for k in kinds}
        self.sizes = {k: np.zeros(per_group, np.int64) for k in kinds}
        self.first = group * per_group

    def _path(self, kind: str, mark: str = "") -> str:
        return f"{self.folder}/{kind}-{self.group}.bin" + (f".{mark}" if mark else "")

    def add(self, shard: int, **arrays: np.ndarray) -> None:
        for k, x in arrays.items():
            self.files[k].write(np.ascontiguousarray(x, np.uint64).tobytes())
            self.sizes[k][shard - self.first] = len(x)

    def close(self) -> None:
        for k, f in self.files.items():
            f.close()
            os.replace(self._path(k, self.mark), self._path(k))
        index = np.stack([np.concatenate([[0], np.cumsum(n)]) for n in self.sizes.values()])
        part = f"{self.folder}/{self.label}-{self.group}.npy.{self.mark}"
        with open(part, "wb") as f:
            np.save(f, index)
        os.replace(part, f"{self.folder}/{self.label}-{self.group}.npy")


def _packed(keys: np.ndarray, *columns: np.ndarray) -> tuple[pa.Array, ...]:
    """One row a distinct key: the key, and each column's values of it as bytes."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    ids = np.unique(keys)
    cuts = [*np.searchsorted(keys, ids), len(keys)]
    return pa.array(ids, pa.int32()), *(pa.array([x[order][a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in columns)


def _by_group(packed: DataFrame, kinds: Sequence[type], shard_of: Callable[..., np.ndarray], groups: int, per_group: int, reduce: Callable, schema: str) -> DataFrame:
    """reduce over the (shard, table) pairs of each group, in ascending order; a table holds one shard's rows of packed columns.

    packed has the group's number and columns of packed values. A group of several shards
    is packed anew by shard and sorted by it where it lies, a sort that spills to disk, so
    its task holds one shard at a time.
    """
    names = packed.columns

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            x = [np.concatenate([np.frombuffer(b, k) for row in held for b in row[i].to_pylist()]) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*_packed(shard_of(*x), *x)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c).slice(i, 1) for c in range(1, len(names))]
                held.append(row)
                size += len(row[0][0].as_py()) // 8
                if size >= POOL_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        now, held = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and ids[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield now, pa.Table.from_batches(held)

    laid = packed.repartitionById(groups, F.col(names[0]))
    if per_group > 1:
        kept = ", ".join(f"{c} {k}" for c, k in packed.dtypes)
        laid = laid.mapInArrow(split, kept).sortWithinPartitions(names[0])
    return laid.mapInArrow(lambda batches: reduce(shards(batches)), schema)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types seen once to four times; a half where one is none."""
    if min(n) == 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def count_model(train: DataFrame, scratch: Scratch, shard_bytes: int = SHARD_BYTES, most_groups: int = GROUPS) -> Model:
    """Counts the bigrams of train.text and writes the model's arrays into the shared folder.

    A shard is a range of context hashes, a group a run of shards. Tasks hand on distinct
    bigrams with counts, packed by group. Frequent contexts are spread over all shards by
    the following word, and their totals, a fixed number, are added up at the end. A
    group's task takes its shards one by one, appends each one's bigrams as hash-sorted
    arrays (those seen once apart, without counts) and its contexts' totals to the group's
    files, and hands on partial counts of its words, which a second round adds up alike by
    ranges of word hashes. The number of shards grows with the text, so what a task holds
    does not; groups, files and what reaches the driver, a row a group and a row a
    frequent context, are bounded. Counts are 64-bit throughout. Null texts count as empty, repeated
    rows count as often as they occur, and an empty table gives a model without words.
    """
    spark = train.sparkSession
    n_bytes = train.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // shard_bytes))
    per = -(-shards // most_groups)
    groups = -(-shards // per)
    folder = local_path(scratch.path("model"))
    os.makedirs(folder, exist_ok=True)
    hot = _hot_contexts(train, shards)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, ws, held = [], [], 0

        def flush() -> pa.RecordBatch:
            u, w = np.concatenate(us), np.concatenate(ws)
            us.clear()
            ws.clear()
            _, at, (n,) = _summed(_pair(u, w), np.ones(len(u), np.int64))
            u, w = u[at], w[at]
            order = np.argsort(u)
            u, w, n = u[order], w[order], n[order]
            return pa.RecordBatch.from_arrays([*_packed(_shard_of(u, w, hot, shards) // per, u, w, n.astype(np.uint32))], names=["grp", "u", "w", "n"])

        for batch in batches:
            for c in B.chunks(batch.column(0)):
                u, w, _ = _tokens(c)
                us.append(u)
                ws.append(w)
                held += len(u)
                if held >= POOL_TOKENS:
                    yield flush()
                    held = 0
        if us:
            yield flush()

    def unpack(t: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in t.column(name)), kind)

    def spread_of(n: np.ndarray) -> np.ndarray:
        return np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], np.int64)

    def reduce_pairs(tables: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
        files, spread, words, held, hots = None, np.zeros(6, np.int64), [], 0, []

        def row(kind: str, ids: pa.Array, packed: list[pa.Array], sums: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids)), ids, *packed, pa.array(sums, pa.list_(pa.int64()))], schema=schema)

        def flush() -> pa.RecordBatch:
            x, _, (raw, kinds) = _summed(*(np.concatenate(c) for c in zip(*words, strict=True)))
            words.clear()
            ids, *packed = _packed(_slot(x, shards) // per, x, raw, kinds)
            return row("w", ids, packed, [None] * len(ids))

        for shard, t in tables:
            files = files or _GroupFiles(folder, "pairs", _PAIRS, shard // per, per)
            u, w, n = unpack(t, "u", np.uint64), unpack(t, "w", np.uint64), unpack(t, "n", np.uint32).astype(np.int64)
            h, at, (n,) = _summed(_pair(u, w), n)
            u, w = u[at], w[at]
            once = n == 1
            spread += [*spread_of(n), n.sum(dtype=np.int64)]
            more = {"once": h[once], "more": h[~once], "more_n": n[~once]}
            h, _, totals = _summed(u, n, *(x.astype(np.int64) for x in (once, n == 2, n >= 3)))
            is_hot = np.isin(h, hot)
            files.add(shard, **more, context=h[~is_hot], context_n=np.stack([x[~is_hot] for x in totals], 1))
            hots += np.stack([h[is_hot].view(np.int64), *(x[is_hot] for x in totals)], 1).tolist()
            x, _, (raw, kinds) = _summed(w, n, np.ones(len(w), np.int64))
            words.append((x, raw, kinds))
            held += len(x)
            if held >= POOL_TOKENS:
                yield flush()
                held = 0
        if files:
            files.close()
            none = lambda k: [pa.nulls(k, pa.binary())] * 3
            if words:
                yield flush()
            hot_rows = np.array(hots, np.int64).reshape(-1, 5)
            key, _, sums = _summed(hot_rows[:, 0], *hot_rows[:, 1:].T)
            if len(key):
                yield row("h", pa.array(np.full(len(key), files.group, np.int32)), none(len(key)), np.stack([key, *sums], 1).tolist())
            yield row("t", pa.array([files.group], pa.int32()), none(1), [spread.tolist()])

    def reduce_words(tables: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
        files, spread = None, np.zeros(6, np.int64)
        for slot, t in tables:
            files = files or _GroupFiles(folder, "words", _WORDS, slot // per, per)
            h, _, (raw, kinds) = _summed(unpack(t, "a", np.uint64), unpack(t, "b", np.int64), unpack(t, "c", np.int64))
            files.add(slot, word=h, word_n=np.stack([raw, kinds], 1))
            spread += [*spread_of(kinds), (kinds >= 3).sum()]
        if files:
            files.close()
            yield pa.RecordBatch.from_arrays([pa.array([files.group], pa.int32()), pa.array([spread.tolist()], pa.list_(pa.int64()))], names=["grp", "spread"])

    schema = pa.schema([("kind", pa.string()), ("grp", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("sums", pa.list_(pa.int64()))])
    packed = train.select(F.col("text").cast("string")).mapInArrow(pairs, "grp int, u binary, w binary, n binary")
    parts = scratch.table(
        _by_group(packed, (np.uint64, np.uint64, np.uint32), lambda u, w, n: _shard_of(u, w, hot, shards), groups, per, reduce_pairs,
                  "kind string, grp int, a binary, b binary, c binary, sums array<long>"), "parts")
    words = scratch.table(
        _by_group(parts.filter("kind = 'w'").select("grp", "a", "b", "c"), (np.uint64, np.int64, np.int64), lambda a, b, c: _slot(a, shards),
                  groups, per, reduce_words, "grp int, spread array<long>"), "words")
    totals = parts.filter("kind = 't'").select("grp", "sums").collect()  # one row of six numbers a group
    pair_spread = sum((np.array(r["sums"]) for r in totals), np.zeros(6, np.int64)).tolist()
    s = F.col("sums")
    summed = parts.filter("kind = 'h'").groupBy(s[0].alias("h")).agg(*[F.sum(s[i]).alias(f"n{i}") for i in range(1, 5)])
    merged = {r[0]: tuple(r[1:]) for r in summed.collect()}  # the frequent contexts
    slots = words.collect()  # one row of six numbers a group
    word_spread = sum((np.array(r["spread"]) for r in slots), np.zeros(6, np.int64)).tolist()
    written = frozenset([f"pairs-{r['grp']}" for r in totals] + [f"words-{r['grp']}" for r in slots])
    scratch.drop(parts, words)
    d, types = _discounts(word_spread[:4]), pair_spread[4]
    given = d[0] * word_spread[0] + d[1] * word_spread[1] + d[2] * word_spread[5]
    return Model(
        folder, shards, per, written, pair_spread[5], word_spread[4], types, _discounts(pair_spread[:4]), d,
        given / types if types else 1.0, merged,
    )


class Reader:
    """Looks hashes up in the sorted arrays, which all workers of a machine share through the page cache."""

    def __init__(self, m: Model):
        self.m = m
        self.hot = np.sort(np.array(list(m.hot), np.int64).view(np.uint64))
        self.hot_n = np.array([m.hot[int(h.view(np.int64))] for h in self.hot], np.int64).reshape(-1, 4)
        self._open: dict[str, np.ndarray | None] = {}

    def _array(self, kind: str, i: int) -> np.ndarray | None:
        """A shard's part of a group's file, None where it has none; a file that was written but can't be seen here is an error."""
        group, at = divmod(i, self.m.per_group)
        label, kinds = ("words", _WORDS) if kind.startswith("word") else ("pairs", _PAIRS)
        keys, width = kinds[kind]
        if f"{label}-{group}" not in self.m.written:
            return None
        for name in (f"{label}-{group}.npy", f"{kind}-{group}.bin"):
            if name not in self._open:
                path = f"{self.m.folder}/{name}"
                if not os.path.exists(path):
                    raise FileNotFoundError(f"{path} is missing: spark.checkpoint.dir must be mounted on every executor")
                if name.endswith(".npy"):
                    self._open[name] = np.load(path)
                else:  # an empty file cannot be mapped
                    self._open[name] = np.memmap(path, np.uint64, "r") if os.path.getsize(path) else None
        first, last = self._open[f"{label}-{group}.npy"][list(kinds).index(keys)][at : at + 2]
        x = self._open[f"{kind}-{group}.bin"]
        return None if x is None or first == last else x[first * width : last * width].reshape(-1, width) if width > 1 else x[first:last]

    def _find(self, keys: str, values: str | None, shard: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
        """Values of sorted-by-shard hashes; zeros where absent, ones where there is no value array."""
        out = np.zeros((len(h), width), np.int64)
        ids = np.unique(shard)
        cuts = [*np.searchsorted(shard, ids), len(shard)]
        for i, a, b in zip(ids, cuts, cuts[1:], strict=False):
            if (k := self._array(keys, int(i))) is None:
                continue
            at = np.searchsorted(k, h[a:b])
            np.minimum(at, len(k) - 1, out=at)
            hit = np.flatnonzero(k[at] == h[a:b])
            if values is None:
                out[a + hit] = 1
            else:
                out[a + hit] = np.asarray(self._array(values, int(i))[at[hit]]).reshape(len(hit), width)
        return out

    def words(self, h: np.ndarray) -> np.ndarray:
        """Token and left-neighbour counts of sorted hashes."""
        return self._find("word", "word_n", _slot(h, self.m.shards), h, 2)

    def contexts(self, h: np.ndarray) -> np.ndarray:
        """Total and numbers of followers seen once, twice and more, of sorted hashes."""
        out = self._find("context", "context_n", _slot(h, self.m.shards), h, 4)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
            hit = self.hot[at] == h
            out[hit] = self.hot_n[at[hit]]
        return out

    def bigrams(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        shard = _shard_of(u, w, self.hot, self.m.shards)
        h = _pair(u, w)
        order = np.lexsort((h, shard))
        s, k = shard[order], h[order]
        n = self._find("once", None, s, k, 1)[:, 0]
        n += self._find("more", "more_n", s, k, 1)[:, 0]
        out = np.empty_like(n)
        out[order] = n
        return out

    def score(self, c: B.Chunk) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base and model log10 probabilities."""
        m = self.m
        u, w, rows = _tokens(c)
        all_words, inverse = np.unique(np.concatenate([w, u[rows[:-1]]]), return_inverse=True)
        iw = inverse[: len(w)]
        iu = np.empty_like(iw)
        iu[1:] = iw[:-1]
        iu[rows[:-1]] = inverse[len(w) :]
        seen = self.words(all_words)
        ctx = self.contexts(all_words)
        d = np.array([0.0, *m.discounts])
        e = np.array([0.0, *m.word_discounts])
        kinds = seen[:, 1]
        types = max(m.bigram_types, 1)
        low = np.maximum(kinds - e[np.minimum(kinds, 3)], 0) / types + m.word_backoff / (m.vocabulary + 1)
        total = np.maximum(ctx[:, 0], 1)
        backoff = np.where(ctx[:, 0] > 0, (ctx[:, 1] * d[1] + ctx[:, 2] * d[2] + ctx[:, 3] * d[3]) / total, 1.0)
        n = self.bigrams(u, w)
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / total[iu] + backoff[iu] * low[iw]
        raw = seen[:, 0][iw]
        base = np.log10(raw + 1.0) - np.log10(float(m.tokens + m.vocabulary + 1))
        heads = rows[:-1]
        return np.diff(rows), np.add.reduceat((raw > 0).astype(np.int64), heads), np.add.reduceat(base, heads), np.add.reduceat(np.log10(p), heads)




SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of every whole text, and the unigram base with one count added.

    Null and empty texts are the end token alone; repeated rows are scored as often as
    they occur; other columns are ignored. Against an empty training set the model gives
    every token the uniform probability of its one unknown word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for c in B.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), *(pa.array(x) for x in reader.score(c))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORES)


def fit_and_score(docs: DataFrame, apart: Column) -> DataFrame:
    """Learns from the rows that `apart` does not hold out and scores all.

    Handling of nulls, empty texts, repeated rows and empty tables is that of
    count_model() and score_texts(); of columns of docs, doc_id, text and those of `apart` are read.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    model = count_model(docs.filter(~apart), scratch)
    return score_texts(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    apart = held_out(7, 2)
    return fit_and_score(docs, apart).withColumn("held_out", apart)
