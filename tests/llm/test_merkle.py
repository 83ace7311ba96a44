import glob
import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from wanetrack.llm import merkle
from wanetrack.llm.scratch import Scratch


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r.n_chars if r.n_chars is None else r.n_chars + more
    return h(*map(field, (r.doc_id, r.source, r.lang, n, r.text)))


def climb(nodes):
    """All levels, and for each first-level node its (side, sibling) list."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for lv in levels[:-1]:
            path.append((i & 1, lv[i ^ 1] if (i ^ 1) < len(lv) else None))
            i >>= 1
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        tops[g] = climb([leaf(r) for r in groups[g]])
    root, over = climb([tops[g][0] for g in order])
    out = []
    for g, above in zip(order, over, strict=True):
        for r, path in zip(groups[g], tops[g][1], strict=True):
            path = path + above
            at = leaf(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            for odd, s in path:
                at = h(at) if s is None else h(s, at) if odd else h(at, s)
            out.append((r.doc_id, leaf(r), tops[g][0], root, h("".join(s for _, s in path if s)), at, at == root))
    return out


def answer(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in merkle.op11_merkle(spark, str(path)).collect()]


def key(t):
    return (t[0] is not None, t[0] or 0, t[1:])


def test_manifest(spark, docs, tmp_path):
    """Nulls, repeated rows, columns with clashing names."""
    assert sorted(answer(spark, docs, tmp_path), key=key) == sorted(brute(docs.collect()), key=key)


@pytest.mark.parametrize(("sizes", "step"), [((1,), 10), ((2, 1), 10), ((1, 1, 1), 1), ((33, 16, 1, 7, 64, 65), 2), ((1025, 3), 3)])
def test_trees_of_any_shape(spark, tmp_path, monkeypatch, sizes, step):
    """Blocks that hold one node, trees higher than a block, lone leaves and more jumps than blocks."""
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(i, None if g == 0 else f"g{g}", "s", i, f"t{i}") for g, n in enumerate(sizes) for i in range(g * 5000, g * 5000 + n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").repartition(5)
    assert sorted(answer(spark, docs, tmp_path), key=key) == sorted(brute(docs.collect()), key=key)


def test_joins_without_broadcast(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert sorted(answer(spark, docs, tmp_path), key=key) == sorted(brute(docs.collect()), key=key)


def test_empty_table(spark, no_docs, tmp_path):
    assert answer(spark, no_docs, tmp_path) == []
    assert merkle.prove(merkle.document_leaves(no_docs), "lang", ["doc_id"]).columns == ["doc_id", "lang", "leaf", "changed", "subroot", "root", "path"]


def test_any_change_is_seen(docs):
    got = merkle.prove(merkle.document_leaves(docs.dropDuplicates(["doc_id"])), "lang", ["doc_id"]).collect()
    for r in got[:20]:
        path, root = bytes(r["path"]), bytes(r["root"])
        assert merkle.fold(bytes(r["leaf"]), path) == root
        for i in range(0, len(path), merkle.LINK):
            if path[i]:
                other = bytearray(path)
                other[i + 5] ^= 1
                assert merkle.fold(bytes(r["leaf"]), bytes(other)) != root
                other = bytearray(path)
                other[i] = 3 - other[i]
                assert merkle.fold(bytes(r["leaf"]), bytes(other)) != root


def test_places_follow_the_order(spark, docs):
    scratch = Scratch(spark, "t")
    got = merkle._placed(docs.select("lang", "doc_id", "text"), ["lang", "doc_id", "text"], scratch).collect()
    got.sort(key=lambda r: r.place)
    assert [r.place for r in got] == list(range(docs.count()))
    want = sorted(((r.lang, r.doc_id, r.text) for r in got), key=lambda t: [(x is not None, x.encode() if isinstance(x, str) else x or 0) for x in t])
    assert [(r.lang, r.doc_id, r.text) for r in got] == want


def test_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(merkle.OP11_SQL)
    cols = want.columns
    assert sorted(map(tuple, merkle.op11_merkle(spark, data).select(*cols).collect())) == sorted(want.fetchall())


def test_one_text_of_many_bytes(spark, tmp_path):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.when(F.col("id") == 1, F.repeat(F.lit("wörd "), 4_000_000)).otherwise("x").alias("text"))
    assert sorted(answer(spark, docs, tmp_path), key=key) == sorted(brute(docs.collect()), key=key)
