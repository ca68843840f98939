import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from lamella.llm import bpe, op3

PATH = op3.vocabulary()
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(7)
    long = "".join(r.choice("abcdeéßñ'12#") for _ in range(9000))
    return ["", " ", "\n\n", "a" * 5000, "ab" * 3001, long, long.upper() + "!" * 900, "x" * 300 + "<|endoftext|>" + "y" * 700 + "'s", "é ́a b c\x1cd", "ΣΣ Σ", "İstanbul " * 3, "日本語" * 400, "it's we'll 123 a1b2", " a\tb\r\nc", "𝒳" * 300]


@pytest.mark.parametrize("leaf", [2, 16])
def test_codec_equals_library(plain, leaf):
    c = bpe.Codec(PATH, leaf=leaf)
    for t in odd_texts():
        assert c.encode(t) == plain.encode(t, add_special_tokens=False).ids, t[:40]
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for t, ids in zip(texts, c.id_bytes(pa.array(texts)), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids)


def test_small_memory_gives_the_same(plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.Codec(PATH)
    for t in ("one two three four", "two five", "one"):
        assert c.encode(t) == plain.encode(t, add_special_tokens=False).ids


def test_query_on_odd_rows(spark, plain, tmp_path):
    rows = [(k, t, "clash") for k, t in enumerate(odd_texts())] + [(None, None, None), (3, "again", None), (3, "again", None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3.op3_bpe(spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *sha, max(0, -(-len(t or "") // bpe.LEAF) - 1)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert op3.op3_bpe(spark, str(tmp_path)).collect() == []


def test_every_plain_character(plain):
    c = bpe.Codec(PATH)
    for k in [*range(0x20, 0x7F), *range(0xA1, 0x250), 0x1E9E, 0x3A3, 0x130]:
        for t in (chr(k), f"a{chr(k)}B", f"x {chr(k)}'S' we'LL{chr(k)} 12.5,'s", f"{chr(k)}{chr(k)}1"):
            assert c.encode(t) == plain.encode(t, add_special_tokens=False).ids, (k, t)


def test_every_long_document_is_joined_from_leaves(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode_decode(docs, PATH).collect()
    assert len(rows) == len(texts)
    want = dict(zip(texts, plain.encode_batch(list(texts.values()), add_special_tokens=False), strict=True))
    for r in rows:
        assert (r.n_joins > 0) == (len(texts[r.doc_id]) > bpe.LEAF)
        assert r.ids == want[r.doc_id].ids and r.decoded == plain.decode(r.ids, skip_special_tokens=False)
    assert sum(r.n_joins for r in rows) > 1000


def test_cuts_inside_words_contractions_marks_and_added_tokens(plain):
    pieces = ["don't", "we'll", "!!'s", "'re", "e\u0301e\u0301", "가\u11a8", "<|endoftext|>", "a\u0327\u0301", "12.5", "'l", "l", "'v", "e", " ", "\n", "?!?!", "İ", "ﬁ", "👩\u200d👩"]
    r = random.Random(11)
    codecs = [bpe.Codec(PATH, leaf=k) for k in (1, 5)]
    for _ in range(80):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(2, 24)))
        want = plain.encode(t, add_special_tokens=False).ids
        for c in codecs:
            assert c.encode(t) == want, (c.leaf, t)


def test_twenty_megabytes_without_a_space(plain):
    r = random.Random(5)
    block = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5_000_011))
    text = block + block[::-1] + block[::2] + block[1::2] + block
    joins = []
    ids, _ = bpe.Codec(PATH).batch(pa.array([text]), joins)
    assert len(text) > 20_000_000 and joins[0] > 19_000
    assert ids.tolist() == plain.encode_batch_fast([text], add_special_tokens=False)[0].ids


def test_long_texts_of_the_other_operators(plain, monkeypatch):
    text = "x" * 700 + "abc " * 600 + "'s" * 300
    monkeypatch.setattr(bpe, "GIVEN", 100)
    assert bpe.Codec(PATH, bpe.LONG).encode(text) == plain.encode(text, add_special_tokens=False).ids
