"""Against the sentencepiece library, also with a character map of its own put into the model file."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from wanetrack.llm import pieces as P


def varint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, raw):
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def with_map(path, rule, prefix, squeeze):
    """The default model's file with the library's own character map `rule`."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    blob = dict(P._fields(next(v for k, v in P._fields(proto) if k == 3))).get(2, b"")
    with open(P.default_model(), "rb") as f:
        kept = b"".join(message(k, v) for k, v in P._fields(f.read()) if k in (1, 2))
    spec = message(1, rule.encode()) + message(2, blob) + varint(3 << 3) + bytes([prefix]) + varint(4 << 3) + bytes([squeeze]) + varint(5 << 3) + b"\1"
    path.write_bytes(kept + message(3, spec))
    return str(path)


@pytest.fixture(scope="module")
def awkward(texts):
    rng = random.Random(1)
    out = [t or "" for t in texts] + ["", " ", "   ", "a", " a  b   c ", "\n", "\n\n x", "▁", "▁▁ a▁b", "日本語テキスト 漢字", "😀😃 x😀", "\0 x", "<s> hi </s>", "<0x0A>", "é é", "x" * 3000, " " * 100, "\t\ta", "ﬁ ｱﾞ Å ㌔", "𒀀𒀁 ㋿", "　a　　b ", "​q﻿", "ﷺ  ﷺ", " ́é", "가각"]
    alphabet = "ab é▁ \n\t日😀ﬁ.,<0xA>́　ｱﾞ①Å  "
    return out + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]


def same_as_library(model_file, texts):
    own, lib = P.PieceModel(model_file), sentencepiece.SentencePieceProcessor(model_file=model_file)
    got = own.encode([t.encode() for t in texts])
    back = own.decode(got.ids, got.starts)
    for i, t in enumerate(texts):
        a, b = got.starts[i], got.starts[i + 1]
        proto = lib.encode(t, return_type="proto")
        assert got.ids[a:b].tolist() == [p.id for p in proto.pieces], t[:80]
        assert list(zip(got.begins[a:b].tolist(), got.ends[a:b].tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces], t[:80]
        assert back[i] == lib.decode([p.id for p in proto.pieces]), t[:80]


def test_default_model(awkward):
    same_as_library(P.default_model(), awkward)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("prefix", "squeeze"), [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_character_maps(awkward, tmp_path, rule, prefix, squeeze):
    same_as_library(with_map(tmp_path / "m", rule, prefix, squeeze), awkward)


def test_decoding_of_any_ids():
    """Broken bytes, control pieces, unknown pieces, byte pieces in front."""
    own, lib = P.PieceModel(P.default_model()), sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    rng = random.Random(2)
    some = [0, 1, 2, 3, 13, 229, 150, 230, 198, 195, 172, 259, 260, 300, 9000, 28705]
    runs = [[rng.choice(some) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    starts = np.cumsum([0] + [len(r) for r in runs])
    got = own.decode(np.array([i for r in runs for i in r]), starts)
    for r, text in zip(runs, got, strict=True):
        assert text == lib.decode(r), r


def test_malformed_bytes_are_replaced():
    own = P.PieceModel(P.default_model())
    got = own.encode([b"a\xff\xc3b", b"", b"\xe6\x97"])
    assert own.decode(got.ids, got.starts) == ["a��b", "", "��"]
    last = got.ends[got.starts[1:] - 1]
    assert last[0] == 4 and last[2] == 2


def test_memory_of_units_is_bounded(awkward, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 50)
    a, b = P.PieceModel(P.default_model()), P.PieceModel(P.default_model())
    for k in range(0, 400, 100):
        some = [t.encode() for t in awkward[k : k + 100]]
        x, y = a.encode(some), b.encode(some)
        assert (x.ids == y.ids).all() and len(a._known) < 20_000
        b._forget()


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), len((r.text or "").encode()), True))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1:])
    assert sorted(map(tuple, P.op13_pieces(spark, str(tmp_path)).collect()), key=order) == sorted(want, key=order)


def test_spans_cut_the_text(docs):
    some = docs.filter("doc_id < 50")
    alone = {tuple(r) for r in P.decode_documents(P.encode_documents(some)).select("doc_id", "decoded").collect()}
    assert alone == {(r.doc_id, r.decoded) for r in P.encode_documents(some, decoded=True).collect()}
    for r in P.encode_documents(some).collect():
        assert len(r.ids) == len(r.begins) == len(r.ends) == r.n_tokens


def test_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op13_pieces(spark, str(tmp_path)).collect() == []


def test_one_text_of_many_bytes(spark):
    """Beside it, a unit of 200,000 characters."""
    word = "the quick brown föx jumps "
    text = word * 800_000
    own, lib = P.PieceModel(P.default_model()), sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    got = own.encode([text.encode(), b"ab" * 100_000])
    assert got.ids[: got.starts[1]].tolist() == lib.encode(text)
    assert got.ids[got.starts[1] :].tolist() == lib.encode("ab" * 100_000)


def test_whole_table():
    own, lib = P.PieceModel(P.default_model()), sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    got = own.encode([t.encode() for t in texts])
    assert [got.ids[a:b].tolist() for a, b in zip(got.starts[:-1], got.starts[1:], strict=True)] == lib.encode(texts)
