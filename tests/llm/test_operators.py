import dataclasses
import glob
import itertools
import os
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wanetrack.llm import bestfit, bytecnn, chroma, components, decontaminate, kneserney, minhash, packing, resharding, suffixmerge, toxicity
from wanetrack.llm import bytesets as B
from wanetrack.llm.labelled import checksum, held_out, labelled_sample
from wanetrack.llm.scratch import Scratch
from wanetrack.llm.tokens import default_tokenizer, encoder


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- near duplicates -----------------------------------------------------------------


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = brute.words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("block", "rounds"), [(256, 2), (4, 0), (4, 1)])
def test_near_duplicates(docs, block, rounds):
    want = brute_near([r for r in rows_of(docs) if r[0] is not None], 4)
    got = minhash.near_duplicates(docs, minhash.NearDup(shingle_words=4, block=block, rounds=rounds)).filter("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_open_band_mates_are_compared(spark):
    """A chain a-b-c in which a and c are not similar, and pivots that miss: the links come from the second look."""
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(w[:90] + [f"x{i}{j}" for j in range(10)]) for i in range(12)] + [" ".join(w)] + [" ".join(w[6:] + ["y"])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (minhash.NearDup(shingle_words=1), minhash.NearDup(shingle_words=1, block=3, rounds=0)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, p).collect()}
        assert got == brute_near(rows, 1)


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Ids that run with several texts, also without words, that no link but the id connects, beside copies of them."""
    say = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(3, "a"), (5, "a"), (5, "b"), (7, "b"), (7, "c"), (9, "c"), (9, "c"), (11, "d"), (12, ""), (12, "e"), (13, "e"), (12, "e"), (14, None), (14, "")]
    df = [(i, say(c) if c else c, k) for k, (i, c) in enumerate(rows)]
    return spark.createDataFrame([*df, (None, say("a"), 90), (None, say("z"), 91)], "doc_id long, text string, n int")


def test_one_answer_for_an_id(shared_ids):
    got = minhash.near_duplicates(shared_ids).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == Counter(
        [(3, 3, True), *[(5, 3, False)] * 2, *[(7, 3, False)] * 2, *[(9, 3, False)] * 2, (11, 11, True), *[(12, 12, True)] * 3, (13, 12, False), *[(14, 14, True)] * 2]
    )
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is None and r.component_id) == [(3, None)]


def test_keep_one_goes_by_text(shared_ids):
    say = {" ".join(f"{c}{i}" for i in range(30)): c for c in "abcdez"}
    out = minhash.keep_one(shared_ids)
    assert out.columns == shared_ids.columns
    got = [(r.doc_id, say.get(r.text, r.text), r.n) for r in out.collect()]
    assert Counter(c for i, c, _ in got if i is not None and c) == Counter("abcde")
    assert {(i, c) for i, c, _ in got if c == "a"} == {(3, "a"), (None, "a")}
    assert sorted((i, c or "") for i, c, _ in got if not c) == [(12, ""), (14, ""), (14, "")]
    assert {c for i, c, _ in got if i is None} == {"a", "z"}
    assert sorted(got, key=str) == sorted(((r.doc_id, say.get(r.text, r.text), r.n) for r in minhash.keep_one(shared_ids.repartition(5)).collect()), key=str)


def test_keep_one(docs, no_docs):
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    want = {i for i, (_, c) in brute_near([r for r in rows_of(docs) if r[0] is not None], 5).items() if i == c}
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert Counter(ids) == Counter([*want, None])
    assert minhash.keep_one(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 100)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.u: r.v for r in components.connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in [*range(101, 120), 200]}}


# --- repeats -------------------------------------------------------------------------


@pytest.mark.parametrize("p", [suffixmerge.Repeats(), suffixmerge.Repeats(length=40, anchor=16, depth=4, shard_bytes=700, group_bytes=3000, pool_bytes=5000, hot=2), suffixmerge.Repeats(length=60, anchor=20, depth=2, hot=3)])
def test_repeats(docs, p):
    rows = rows_of(docs)
    flags = brute.repeats([t for _, t in rows], p.length)
    want = Counter()
    for (i, t), f in zip(rows, flags):
        raw = (t or "").encode()
        want[i, len(raw), sum(f), sum(1 for j in range(len(f)) if f[j] and (j == 0 or not f[j - 1])), bytes(b for b, g in zip(raw, f) if not g)] += 1
    got = suffixmerge.remove_repeats(docs, p).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_cut_repeats_keeps_rows_and_columns(docs, no_docs):
    out = suffixmerge.cut_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() == docs.count()
    assert out.filter("n_chars <> char_length(text)").count() == 0
    assert suffixmerge.cut_repeats(no_docs).count() == 0


def test_merge_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        shards, base, suffixes = [], 0, {}
        for t in texts:
            nxt = np.append(np.arange(1, len(t)), -1)
            shards.append(suffixmerge.transform(suffixmerge.suffix_order(t, nxt, 4), t, nxt))
            suffixes |= {base + i: tuple(t[i : i + 4]) for i in range(len(t))}
            base += len(t)
        place, shared = suffixmerge.merge_shards(shards, 4)
        order = [suffixes[p] for p in place]
        assert order == sorted(suffixes.values())
        for a, b, n in zip(order, order[1:], shared[1:]):
            k = next((i for i in range(4) if a[i : i + 1] != b[i : i + 1]), 4)
            if len(a) == 4 or k < 4:
                assert n == k or (k > len(b) - 1 and n >= k)


def test_transforms_of_different_partitions_are_merged(spark, monkeypatch):
    """Texts that share an anchor but differ around it lie in four partitions; their group gets a transform of each."""
    rng = np.random.default_rng(13)
    core = bytes(rng.integers(97, 123, 150).astype(np.uint8)).decode()
    side = lambda: bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
    left = side()
    texts = [side() + core + side() for _ in range(8)] + [left + core + side() for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, cut = {}, suffixmerge._transforms

    def kept_transforms(*a):
        seen["shards"] = Scratch(spark, "t").table(cut(*a).withColumn("pid", F.spark_partition_id()), "shards")
        return seen["shards"].drop("pid")

    monkeypatch.setattr(suffixmerge, "_transforms", kept_transforms)
    p = suffixmerge.Repeats(length=80, anchor=20)
    got = {r.doc_id: r.n_removed for r in suffixmerge.remove_repeats(docs, p).collect()}
    flags = brute.repeats(texts, 80)
    assert got == {i: sum(f) for i, f in enumerate(flags)}
    shards = seen["shards"].groupBy("grp").agg(F.countDistinct("pid").alias("tasks")).collect()
    assert max(r.tasks for r in shards) > 1


# --- sharding ------------------------------------------------------------------------


def brute_flow(supply, capacity, cost):
    best = None
    old, new = sorted(supply), sorted(capacity)

    def fill(k, left, total):
        nonlocal best
        if k == len(old):
            best = total if best is None else min(best, total)
            return
        for split in itertools.product(*[range(min(supply[old[k]], left[j]) + 1) for j in new]):
            if sum(split) == supply[old[k]]:
                fill(k + 1, {j: left[j] - s for j, s in zip(new, split)}, total + sum(s * cost(old[k], j) for j, s in zip(new, split)))

    fill(0, dict(capacity), 0)
    return best


def test_flow_is_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(25):
        supply = {i: int(rng.integers(0, 4)) for i in range(3)}
        capacity = resharding.equal_capacities(sum(supply.values()) + int(rng.integers(0, 3)), 3)
        table = rng.integers(0, 4, (3, 3))
        cost = lambda i, j, t=table: int(t[i][j])
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert sum(v * cost(*k) for k, v in flow.items()) == brute_flow(supply, capacity, cost)
        for i, s in supply.items():
            assert sum(v for k, v in flow.items() if k[0] == i) == s
        for j, c in capacity.items():
            assert sum(v for k, v in flow.items() if k[1] == j) <= c


def test_reshard(docs, no_docs):
    got = resharding.reshard(docs, F.crc32(F.col("source").cast("binary")) % 6, 6).collect()
    assert len(got) == docs.count()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes[j] for j in range(6)) <= 2 * max(r.size for r in got)
    assert resharding.reshard(no_docs, F.lit(0)).count() == 0


def test_rewritten_shards_hold_every_row_once(spark, docs, tmp_path):
    """With null ids, repeated rows and columns named as the plan's own."""
    from pyspark.testing import assertDataFrameEqual

    mine = docs.union(docs.filter("doc_id is null")).withColumn("Shard", F.lit("mine")).withColumn("slot", F.lit(7))
    plan = resharding.reshard(mine, F.crc32(F.col("source").cast("binary")) % 6, 6, whole=True)
    shards = {r[0] for r in resharding.rewrite_affected(plan, str(tmp_path / "out")).collect()}
    assert shards >= set(range(6))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == [*mine.columns, "slot_", "shard_"]
    assertDataFrameEqual(out.select(*mine.columns), mine)
    slots = defaultdict(list)
    for r in out.select("shard_", "slot_").collect():
        slots[r.shard_].append(r.slot_)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- tokens --------------------------------------------------------------------------


def ids_of(text):
    return [*encoder(default_tokenizer()).encode(text or "").tolist(), 0]


def test_encoder_agrees_with_its_file(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    sample = [x for x in texts if x] + ["a<|endoftext|>b", "naïve  — 漢字 🙂\n\n x"]
    for text, enc in zip(sample, t.encode_batch(sample, add_special_tokens=False)):
        assert encoder(default_tokenizer()).encode(text).tolist() == enc.ids


def test_concatenated(docs, no_docs):
    got = packing.pack_concatenated(docs, length=64).collect()
    by_doc = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (len(ids), zlib.crc32(r.ids)) == (r.length, r.ids_crc32)
        by_doc[r.doc_id, r.sequence_id * 64 + r.offset - r.start].append((r.start, ids, r.doc_tokens))
    built = Counter((k[0], tuple(i for _, ids, _ in sorted(v) for i in ids)) for k, v in by_doc.items())
    assert built == Counter((i, tuple(ids_of(t))) for i, t in rows_of(docs))
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n == 64 for s, n in fill.items() if s < max(fill))
    assert sorted(fill) == list(range(max(fill) + 1))
    assert packing.pack_concatenated(no_docs).count() == 0


def test_best_fit(docs, no_docs):
    got = bestfit.pack_best_fit(docs, length=64, pool_tokens=5000).collect()
    parts = defaultdict(dict)
    for r in got:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[d].setdefault(s, []).append(tuple(ids[a:b].tolist()))
        assert not ids[r.n_tokens :].any()
    for i, t in {r for r in rows_of(docs) if Counter(x for x, _ in rows_of(docs))[r[0]] == 1}:
        assert [x for s in sorted(parts[i]) for x in parts[i][s][0]] == ids_of(t)
    assert sum(r.n_tokens for r in got) == sum(len(ids_of(t)) for _, t in rows_of(docs))
    assert len({r.sequence_id for r in got}) == len(got)
    assert bestfit.pack_best_fit(no_docs).count() == 0


def test_written_sequences_give_the_texts_back(spark, docs, no_docs, tmp_path):
    """From the files alone: ids, segment lengths and position resets."""
    bestfit.write_packed(bestfit.pack_best_fit(docs, length=64, pool_tokens=5000), str(tmp_path / "packed"))
    table = pq.read_table(str(tmp_path / "packed")).to_pylist()
    pieces = Counter()
    for r in table:
        ids, pos = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert np.flatnonzero(pos[: r["n_tokens"]] == 0).tolist() == r["cu_seqlens"][:-1]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces[d, s, tuple(ids[a:b].tolist())] += 1
    want = Counter((i, s, tuple(x[s : s + 64])) for i, t in rows_of(docs) for x in [ids_of(t)] for s in range(0, len(x), 64))
    assert pieces == want
    bestfit.write_packed(bestfit.pack_best_fit(no_docs), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_capacity_tree_is_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 400)
    bins = bestfit.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(400))
    plain = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [b for b in plain if b + lengths[i] <= 64]
        if fits:
            plain[plain.index(max(fits))] += lengths[i]
        else:
            plain.append(lengths[i])
    assert sorted(int(sum(lengths[i] for i in b)) for b in bins) == sorted(map(int, plain))


# --- decontamination -----------------------------------------------------------------


def test_leaks(spark, docs, no_docs, texts):
    items = [(1, " ".join(texts[70].split()[45:85])), (2, " ".join(texts[5].split()[:30])), (3, None), (4, ""), (5, "one two"), (6, "not in any text at all, this one"), (7, " ".join(texts[70].split()[45:85]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    want = {}
    for i, t in rows_of(docs):
        w = brute.words(t)
        for item, text in items:
            x = brute.words(text)
            ref, best = Counter(sh(x)), 0.0
            if not x:
                continue
            for a in range(max(1, len(w) - len(x) + 1)):
                got = Counter(sh(w[a : a + len(x)]))
                low = sum((got & ref).values())
                best = max(best, low / (sum(got.values()) + sum(ref.values()) - low)) if got else best
            if best >= 0.8:
                want[i, item] = best
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, decontaminate.Leak(item_block=2, run_windows=3)).collect()} == set(want)
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in rows_of(docs) if i not in {d for d, _ in want})
    assert decontaminate.leaks(no_docs, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_hamming_search_is_complete():
    rng = np.random.default_rng(5)
    items = decontaminate.Items(list(range(50)), [" ".join(map(str, rng.integers(0, 9999, 20))) for _ in range(50)], decontaminate.Leak())
    probes = items.prints[rng.integers(0, 50, 300)].copy()
    for k in range(300):
        for b in rng.integers(0, 64, k % 30):
            probes[k] ^= np.uint64(1) << np.uint64(b)
    want = {(i, j) for i in range(300) for j in range(50) if np.bitwise_count(probes[i] ^ items.prints[j]) <= 20}
    assert set(items.near(20, probes)) == want


# --- language model ------------------------------------------------------------------


def test_kneser_ney(docs, no_docs):
    apart = held_out(7, 2)
    rows = rows_of(docs)
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    got = kneserney.fit_and_score(docs, apart).collect()
    want = defaultdict(list)
    for (i, _), s in zip(rows, brute.kneser_ney(train, [t for _, t in rows])):
        want[i].append(s)
    assert len(got) == len(rows)
    for r in got:
        n, known, base, score = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert (r.base_score, r.score) == (pytest.approx(base), pytest.approx(score))
    assert kneserney.fit_and_score(no_docs, apart).count() == 0
    alone = kneserney.fit_and_score(docs, F.lit(True)).collect()
    assert len(alone) == len(rows) and {r.train_tokens for r in alone} == {0}


def test_counts_beyond_32_bits_and_missing_files(spark):
    """Every count is made five thousand million times larger between the two rounds of adding up."""
    docs = spark.createDataFrame([(i, "a b a b c") for i in range(8)], "doc_id long, text string")
    model = kneserney.count_model(docs, Scratch(spark, "t"))
    big = 5_000_000_000
    for name in ("word_n", "context_n", "more_n"):
        for f in glob.glob(f"{model.folder}/{name}-*.bin"):
            (np.fromfile(f, np.uint64) * np.uint64(big)).tofile(f)
    model = dataclasses.replace(model, tokens=model.tokens * big, hot={k: tuple(big * x for x in v) for k, v in model.hot.items()})
    reader = kneserney.Reader(model)
    (c,) = B.chunks(pa.array(["a b zz"]))
    n, known, base, score = (x[0] for x in reader.score(c))
    counts = [16 * big, 16 * big, 0, 8 * big]
    assert (n, known) == (4, 3)
    assert base == pytest.approx(sum(np.log10(float(k + 1)) for k in counts) - 4 * np.log10(float(48 * big + 5)))
    assert np.isfinite(score)
    os.remove(glob.glob(f"{model.folder}/word-*.bin")[0])
    with pytest.raises(FileNotFoundError):
        for i in range(model.shards):
            kneserney.Reader(model)._array("word", i)


def test_groups_of_shards_hold_what_single_shards_do(spark, docs, monkeypatch):
    """Many shards in few groups, pools of few tokens: equal totals and scores, files and driver rows by group."""
    plain = kneserney.count_model(docs, Scratch(spark, "t"))
    monkeypatch.setattr(kneserney, "POOL_TOKENS", 500)
    grouped = kneserney.count_model(docs, Scratch(spark, "t"), shard_bytes=200, most_groups=3)
    assert plain.per_group == 1 and grouped.shards > 100 and grouped.per_group > 30
    assert len(grouped.written) <= 6 and len(glob.glob(f"{grouped.folder}/*")) <= 3 * 9
    for name in ("tokens", "vocabulary", "bigram_types", "discounts", "word_discounts", "word_backoff"):
        assert getattr(plain, name) == getattr(grouped, name), name
    score = lambda m: sorted(map(tuple, kneserney.score_texts(docs, m).collect()), key=str)
    assert score(plain) == score(grouped)


# --- audio ---------------------------------------------------------------------------


def test_items_against_plain_filters():
    """Bits of responses that lie on a threshold may differ; all others may not."""
    rng = np.random.default_rng(11)
    for p, data in ((chroma.SCORES, rng.integers(0, 12, 300)), (chroma.Audio(), rng.integers(0, 256, 2000))):
        data = data.astype(np.uint8)
        got, off = chroma.fingerprint_chunk(B.Chunk(0, 1, data, np.array([0, len(data)])), p)
        want = brute.chroma_items(data.tolist(), p)
        assert off[-1] == len(got) == len(want)
        for x, (bits, sure) in zip(got.tolist(), want):
            assert x & sure == bits & sure


@pytest.fixture(scope="module")
def sounds(spark, docs):
    """Scores of texts: some with a third of a long passage, with edits, and as heads and tails of others."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    base, rows = word(700), []
    for i in range(40):
        w = list(base[8 * (i % 7) :])
        for k in rng.integers(0, len(w), i // 2):
            w[k] = f"e{i}{k}"
        rows.append(w if i % 3 else w[:320] + word(300))
    rows += [word(n) for n in (1, 5, 90, 95, 100, 110, 125, 130)]
    rows += [rows[0][:200], rows[1], word(300) + rows[2]]
    texts = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    return chroma.text_scores(docs.select("doc_id", "text").union(texts))


@pytest.mark.parametrize("p", [chroma.SCORES, chroma.Audio(score=True, frame=32, hop=8, rounds=0, few=3, block=5), chroma.Audio(score=True, frame=32, hop=8, rounds=1, few=0, block=8)])
def test_chroma_against_brute_force(sounds, no_docs, p):
    prints = [(r.rec_id, np.frombuffer(r.items, "<u4").tolist()) for r in chroma.fingerprints(sounds, p).collect()]
    got = chroma.match_recordings(sounds, p).collect()
    assert len(got) == len(prints)
    distinct = sorted({tuple(x) for _, x in prints if x})
    pairs = {(a, b): brute.alignment(a, b, p) for a in distinct for b in distinct if a != b}
    pairs = {k: v for k, v in pairs.items() if v}
    assert 40 < len(pairs)
    nodes = [*distinct, *{i for i, x in prints if i is not None}]
    edges = [*pairs, *((i, tuple(x)) for i, x in prints if x and i is not None)]
    root = brute.components(nodes, edges)
    least = {}
    for i, _ in prints:
        if i is not None:
            least[root[i]] = min(least.get(root[i], i), i)
    items = {}
    for i, x in sorted((r for r in prints if r[1] and r[0] is not None), reverse=True):
        items[tuple(x)] = i
    by_copy = defaultdict(set)
    for x, i in items.items():
        by_copy[i].add(x)
    for r in got:
        assert r.class_id == (None if r.rec_id is None else least[root[r.rec_id]])
        assert r.kept == (None if r.rec_id is None else r.class_id == r.rec_id)
        if r.match_id is not None:
            want = {v for a in by_copy[r.copy_of] for b in by_copy[r.match_id] if (v := pairs.get((a, b)))}
            assert (r.match_offset, r.match_equal_items, r.match_overlap, r.match_bit_errors) in want
    linked = {x for k in pairs for x in k}
    assert {r.copy_of for r in got if r.match_id is not None} >= {items[x] for x in linked if x in items}
    assert chroma.match_recordings(chroma.text_scores(no_docs), p).count() == 0


def test_shifted_sound_aligns():
    p = chroma.Audio()
    rng = np.random.default_rng(6)
    t = np.arange(40_000)
    sound = 128 + 60 * np.sin(2 * np.pi * np.repeat(rng.choice([262, 330, 392, 440, 523], 50), 800) * t / p.rate)
    sound = np.clip(sound + rng.normal(0, 1, len(t)), 0, 255).astype(np.uint8)
    cut = sound[64 * 100 :]
    a, _ = chroma.fingerprint_chunk(B.Chunk(0, 1, sound, np.array([0, len(sound)])), p)
    b, _ = chroma.fingerprint_chunk(B.Chunk(0, 1, cut, np.array([0, len(cut)])), p)
    found = chroma.align(a, b)
    assert found.offset == 100 and found.equal == found.overlap == len(b) and found.errors == 0


def test_short_excerpts_and_tails_are_found(spark):
    """A tenth of a long recording, and an end that another begins with, beside recordings that share nothing."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    long, tail = word(4000), word(400)
    texts = [long, long[800:1200], word(3000) + tail, tail + word(2000), word(400), word(4000)]
    scores = chroma.text_scores(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.rec_id: r for r in chroma.match_recordings(scores, chroma.SCORES).collect()}
    assert [got[i].class_id for i in range(6)] == [0, 0, 2, 2, 4, 5]
    assert (got[0].match_id, got[0].match_offset) == (1, 100) and got[0].match_equal_items == got[0].match_overlap == 40
    assert (got[2].match_id, got[2].match_offset) == (3, 375)


# --- classifiers ---------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


@pytest.mark.parametrize(("op", "label", "least"), [("toxicity", "toxic", 0.8), ("quality", "quality", 0.97)])
def test_held_out_accuracy(spark, op, label, least):
    d = "/root/testdata/sf0.1"
    query = toxicity.op5_toxicity if op == "toxicity" else bytecnn.op8_quality
    rows = query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert (rows["predicted"] == rows[label]).mean() > (0.93 if op == "toxicity" else 0.97)


def test_classifiers_on_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels, g=toxicity.Grams(steps=200))
    net = bytecnn.train_quality(docs, labels, limit=8)
    for out in (toxicity.score_toxicity(docs, model), bytecnn.score_quality(docs, net)):
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for out in (toxicity.score_toxicity(no_docs, model), bytecnn.score_quality(no_docs, net), bytecnn.keep_quality(no_docs, net)):
        assert out.count() == 0
    kept = bytecnn.keep_quality(docs, net, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    none = labels.limit(0)
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, none)).collect()} == {0.5}
    assert {r.score for r in bytecnn.score_quality(docs, bytecnn.train_quality(docs, none)).collect()} == {0.5}


def test_labelled_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i, c * 10) for i in range(40) for c in ("b", "a", "c")] + [(50, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (3, 0), (50, 1), (51, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 30)
    assert len(got) == 30 - (51 in {r.doc_id for r in labels.filter("toxic is not null").select("doc_id").distinct().orderBy(checksum(), "doc_id").limit(30).collect()})
    assert set(got["text"]) <= {"a" * 10, ""}
    assert got.equals(labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", F.lit(True), 30))
    assert 10 <= len(labelled_sample(docs, labels, "toxic", F.lit(True), 30, max_bytes=110)) <= 12
    assert labelled_sample(docs.limit(0), labels, "toxic", F.lit(True), 30).empty


def test_toxicity_against_plain_python(spark):
    """Features, log-count ratios and scores from strings and dictionaries; the 22-bit slot is the hash's."""
    g = toxicity.Grams(sizes=(2, 4), bits=16, steps=400)
    rng = np.random.default_rng(14)
    texts = ["".join(rng.choice(list("abcdeéX "), rng.integers(0, 60))) + (" böse" if i % 3 == 0 else "") for i in range(90)] + ["", "a"]
    y = np.array([int(i % 3 == 0) for i in range(90)] + [0, 1])
    slot = lambda gram: brute.poly_hash("".join(c.lower() if c in "X" else c for c in gram).encode()) >> (64 - g.bits)
    sets = [{slot(t[i : i + n]) for n in g.sizes for i in range(len(t) - n + 1)} for t in texts]
    got = [set(x.tolist()) for c in B.chunks(pa.array(texts)) for x in toxicity.features(c, g)]
    assert got == sets
    ratio = toxicity.log_count_ratios([np.array(sorted(s), np.int32) for s in sets], y, g)
    pos, neg = y.sum() + 2, len(y) - y.sum() + 2
    for s in set().union(*sets):
        a, b = (1 + sum(s in x for x, k in zip(sets, y) if k == v) for v in (1, 0))
        assert ratio[s] == pytest.approx(np.log(a / pos) - np.log(b / neg), abs=1e-5)
    weights, bias = toxicity.fit(pd.DataFrame({"text": texts, "label": y}), g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, (weights, bias), g).collect()}
    for i, s in enumerate(sets):
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(bias + sum(float(weights[k]) for k in s)))), abs=1e-6)
    loss = lambda p: -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    assert loss(np.array([scores[i] for i in range(len(texts))])) < 0.7 * loss(np.full(len(texts), y.mean()))


def test_byte_network_against_plain_convolution_and_differences():
    rng = np.random.default_rng(15)
    shape = bytecnn.Shape(filters=3, width=4, half=10)
    net = bytecnn.ByteCNN(shape)
    net.table, net.out, net.bias = net.table.astype(np.float64), rng.normal(0, 1, 9), 0.3
    raw = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 3, 4, 9, 10, 11, 20, 21, 35, 100)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    got = net.probabilities(np.frombuffer(b"".join(raw), np.uint8), off)
    assert got == pytest.approx([brute.byte_network(t, net.table, net.out, net.bias, shape) for t in raw], abs=1e-6)
    y = rng.integers(0, 2, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    loss = lambda: float(-np.mean(np.where(y == 1, np.log(net.probabilities(data, off)), np.log(1 - net.probabilities(data, off)))))
    table, out, bias = net.gradient(data, off, y)
    for p, d in ((net.table, table), (net.out, out)):
        for i in rng.permutation(np.flatnonzero(np.abs(d) > 1e-4))[:25]:
            at, h = np.unravel_index(i, p.shape), 1e-5
            keep = p[at]
            p[at] = keep + h
            up = loss()
            p[at] = keep - h
            down = loss()
            p[at] = keep
            assert (up - down) / (2 * h) == pytest.approx(d[at], rel=0.02, abs=1e-5)


def test_quality_scores_do_not_depend_on_neighbours(texts):
    rng = np.random.default_rng(8)
    net = bytecnn.ByteCNN()
    net.out = rng.normal(0, 1, len(net.out)).astype(np.float32)
    raw = [(t or "").encode() for t in texts] + [b"", b"a", b"z" * 191, b"z" * 192, b"z" * 193, b"", b"\xff" * 50, b""]
    alone = [net.probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in raw]
    for order in (np.arange(len(raw)), rng.permutation(len(raw))):
        off = np.concatenate([[0], np.cumsum([len(raw[i]) for i in order])])
        got = net.probabilities(np.frombuffer(b"".join(raw[i] for i in order), np.uint8), off)
        assert got == pytest.approx([alone[i] for i in order], abs=1e-6)
    assert len({round(alone[i], 6) for i, t in enumerate(raw) if not t}) == 1


def test_toxicity_reads_characters_of_several_sizes():
    count = lambda t, g: [len(x) for c in B.chunks(pa.array(t)) for x in toxicity.features(c, g)]
    assert count(["abcdefgh", "ä" * 8, "ä" * 3, "", None, "abcD"], toxicity.Grams()) == [5 + 3 + 1, 3, 0, 0, 0, 1]
    assert count(["aé漢🙂b"], toxicity.Grams(sizes=(2,))) == [4]
