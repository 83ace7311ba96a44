import random
import shutil
from collections import Counter, defaultdict

import brute
import pytest
from conftest import words

import corpus_pipeline
from wanetrack.llm import bytecnn
from wanetrack.llm.tokens import default_tokenizer, encoder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose, near copies, a shared passage, junk, a leaked item; repeated ids with equal and other texts, nulls and a null id."""
    rng = random.Random(21)
    rows = [words(rng, rng.randint(20, 200)) for _ in range(40)]
    base, passage, item = words(rng, 150).split(), words(rng, 80), words(rng, 30)
    for i in range(6):
        copy = list(base)
        copy[rng.randrange(150)] = f"x{i}"
        rows.append(" ".join(copy))
    rows += [f"{words(rng, 60)} {passage} {words(rng, 60)}" for _ in range(5)] + [f"{words(rng, 20)} {item} {words(rng, 20)}"]
    rows += ["#$%& " * rng.randint(10, 80) for _ in range(30)] + [None, "", "one"]
    rows = list(enumerate(rows)) + [(3, rows[3]), (5, words(rng, 50)), (6, rows[7]), (None, words(rng, 40))]
    labels = [(i, 0 if 52 <= i < 82 else 1, 0) for i in range(84)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)
    return df, rows, labels, [(1, item), (2, None), (3, words(rng, 25))]


def near_groups(rows, k=5, percent=80):
    """Groups of texts as lists of (id, text); rows without words or id are apart."""
    sets = []
    for _, t in rows:
        w = brute.words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = brute.components(range(len(rows)), links)
    groups, out = defaultdict(list), []
    for n, (i, t) in enumerate(rows):
        if i is None:
            out.append([(i, t)])
        else:
            groups[root[n] if sets[n] else ("no words", i, t)].append((i, t))
    return out + list(groups.values())


def test_stages_against_brute_force(spark, corpus, tmp_path):
    df, rows, labels, items = corpus
    d = folder(spark, tmp_path, labels, items)
    net = bytecnn.train_quality(df, spark.read.parquet(f"{d}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def step(docs, name):
        out = stages[name](spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    now = step(df, "quality classifier")
    assert now.columns == df.columns
    score = {t: brute.byte_network((t or "").encode(), net.table, net.out, float(net.bias), net.shape) for _, t in rows}
    assert min(abs(p - 0.3) for p in score.values()) > 1e-4
    want = [(i, t) for i, t in rows if score[t] >= 0.3]
    assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter(want)
    assert 40 < len(want) < len(rows)

    now = step(now, "MinHash near-dedup")
    got = [(r.doc_id, r.text) for r in now.collect()]
    groups, often = near_groups(want), Counter(i for i, _ in want)
    assert len(got) == len(groups)
    for g in groups:
        (stays,) = set(g) & set(got)
        alone = [r for r in g if often[r[0]] == 1]
        assert stays == (min(alone, key=lambda r: r[0]) if alone and g[0][0] is not None else stays)

    passages = step(now, "suffix-array dedup")
    flags = dict(zip(got, brute.repeats([t for _, t in got], 200)))
    assert any(any(f) for f in flags.values())
    cut = {}
    for (i, t), f in flags.items():
        raw, parts, at = (t or "").encode(), [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and f[end] == f[at]:
                end += 1
            if not f[at]:
                parts.append(raw[at:end].decode("utf-8", "ignore"))
            at = end
        cut[i, t] = "".join(parts)
    kept = [(r.doc_id, r.text, r.n_chars) for r in passages.collect()]
    assert Counter(kept) == Counter((i, x, len(x)) for (i, _), x in cut.items())

    clean = step(passages, "benchmark decontamination")
    leaked = {i for i, t, _ in kept if i is not None and any(x and similar(t, x) for _, x in items)}
    assert leaked
    left = [(i, t) for i, t, _ in kept if i not in leaked]
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(left)

    pieces = defaultdict(int)
    for r in step(clean, "packing").collect():
        pieces[r.doc_id] += r.length
    want_tokens = Counter()
    for i, t in left:
        want_tokens[i] += len(encoder(default_tokenizer()).encode(t)) + 1
    assert dict(pieces) == dict(want_tokens)


def similar(text, item, k=5):
    """Whether a window of the item's words in the text has weighted shingle similarity 0.8."""
    grams = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])
    a, b = brute.words(text), brute.words(item)
    ref = grams(b)
    for s in range(max(1, len(a) - len(b) + 1)):
        win = grams(a[s : s + len(b)])
        low = sum((win & ref).values())
        if a and low >= 0.8 * (win.total() + ref.total() - low):
            return True
    return False


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, corpus, tmp_path, empty):
    df, _, labels, items = corpus
    spark.createDataFrame(labels[: 0 if empty == "labels" else None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items[: 0 if empty == "benchmark" else None], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    (df.limit(0) if empty == "documents" else df).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() > 0) == (empty != "documents")


def test_stages_keep_columns_and_filter(spark, docs, tmp_path):
    src = "/root/testdata/sf0.001"
    for t in ("labels", "benchmark"):
        shutil.copy(f"{src}/{t}.parquet", tmp_path / f"{t}.parquet")
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{i}"))
        out = spark.read.parquet(str(tmp_path / f"{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == now.columns, name
            assert out.count() <= now.count()
            now = out
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids


def test_run_on_data(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
