"""Byte-level BPE beside the rank file's own library."""

import base64
import hashlib
import random
import struct

import pytest
import tiktoken

from rasterloom.llm import bytebpe, catalog

RANKS = f"{catalog.TOKENIZERS}/byte_bpe_50k.tiktoken"


def library(rank_file):
    return tiktoken.Encoding("own", pat_str=catalog.PATTERN, mergeable_ranks=bytebpe.ranks_of(rank_file), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(RANKS, catalog.PATTERN)


def odd_texts(n):
    draw = random.Random(11)
    pool = [0x558, 0x58B, 0x88F, 0x11DE0, 0x1246F, 0x85, 0xA0, 0xB2, 0xBD, 0x2028, 0x3000, 0x1C, 0x1F, 0, 0xAD, 0x300, 0x1F600, 0x4E00, 0x323B0, 0x61, 0x20, 0x27, 0x73, 0x0A]
    code = lambda: draw.choice(pool) if draw.random() < 0.6 else draw.randrange(0x520) if draw.random() < 0.6 else draw.choice([draw.randrange(0xD800), draw.randrange(0xE000, 0x110000)])
    return ["".join(chr(code()) for _ in range(draw.randrange(40))) for _ in range(n)]


def test_ids_are_the_librarys(codec):
    texts = ["", "it's they'RE we'll  a\n\n b", "a" * 100_000, " " * 50_000 + "x", "\t \n", "é" * 9_999, "<|endoftext|>", *odd_texts(3_000)]
    worker, ours = codec.ready(), library(RANKS)
    got = worker.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        expected = ours.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(expected)}I", *expected), text[:80]
        assert worker.decode(ids) == text.encode()
    assert all(worker.model.encode(bytebpe.mapped(token), out_type=int) == [rank] for token, rank in list(bytebpe.ranks_of(RANKS).items())[::97])


def test_slices_and_a_small_cache(codec, monkeypatch):
    texts, worker = [*odd_texts(40), "word " * 40], codec.ready()
    whole = worker.encode(texts)
    monkeypatch.setattr(bytebpe, "_LONG", 7)
    monkeypatch.setattr(bytebpe, "_GROUP", 3)
    monkeypatch.setattr(worker, "most", 5)
    assert worker.encode(texts) == whole


def test_free_ranks_and_tokens_beyond_merges(tmp_path):
    """A token that no merge reaches is still the id of a pre-token that equals it."""
    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 260, b"bc": 258, b"abcd": 270, b"  ": 300, "é".encode(): 299}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in tokens.items()))
    worker, ours = bytebpe.Codec(str(path), catalog.PATTERN).ready(), library(str(path))
    texts = ["abcd", "abc", "xabcd", "é", "éé", "    a", "abab", "<free 257>"]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in worker.encode(texts)] == [ours.encode_ordinary(t) for t in texts]
    assert [worker.decode(x).decode() for x in worker.encode(texts)] == texts
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError, match="all 256 bytes"):
        bytebpe.Codec(str(path), catalog.PATTERN)


def test_rows(spark, codec):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "a b", "z"), (2, "", None), (3, "né 12 " * 5_000, "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bytebpe.decode(bytebpe.encode(table, codec), codec).withColumn("numbers", bytebpe.as_numbers("ids"))
    ours = library(RANKS)
    expected = sorted(((i, ours.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.numbers, bytes(r.decoded)) for r in got.collect()), key=repr) == expected
    assert [r.n_tokens for r in got.where("doc_id = 3").collect()] == [len(ours.encode_ordinary(rows[-1][1]))]
    assert bytebpe.encode(table.limit(0), codec).count() == 0
    broken = table.selectExpr("doc_id", "cast(X'61FF62' as string) as text").limit(1)
    assert bytes(bytebpe.decode(bytebpe.encode(broken, codec), codec).first().decoded) == "a�b".encode()


def test_query(spark, sf_dir):
    ours = library(RANKS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.op11_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = ours.encode_ordinary(texts[row.doc_id])
        assert tuple(row)[1:] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[row.doc_id].encode()).hexdigest())
