import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lamella.llm import op3, op7, op8, packing, planes

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("bin", T.StringType())])
ROWS = [(5, "a b c", 1, "x"), (1, None, 1, "x"), (2, "", None, None), (9, "word " * 9000, 3, ""), (None, "no id", 0, None), (5, "a b c", 1, "x"), (5, "zz", 1, "x"), (-4, "q", 2, "y")]


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()
        super().close()


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op3.vocabulary())


@pytest.fixture
def ids_of(tok):
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block", [1, 3, 64])
def test_planes_round_trip(bits, block):
    r = np.random.default_rng(0)
    docs = [(k if k % 3 else None, r.integers(0, 2**32, r.integers(0, 40), dtype=np.uint64).astype("<u4").tobytes()) for k in range(20)]
    out = Sink()
    w = planes.PlaneWriter(out, bits, block)
    for k in range(0, 20, 7):
        w.add([d for d, _ in docs[k : k + 7]], [x for _, x in docs[k : k + 7]])
    w.close()
    got = list(planes.read_planes(pa.BufferReader(out.kept)))
    assert [(d, x) for d, _, x in got] == docs
    assert [s for _, s, _ in got] == np.cumsum([0] + [len(x) // 4 for _, x in docs])[:-1].tolist()


def brute7(rows, ids_of):
    at, out = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(t), 1]
        out.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op7_brute(spark, tmp_path, ids_of):
    spark.createDataFrame(ROWS, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op7.op7_token_planes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute7(ROWS, ids_of)


def check_packing(rows, got, ids_of, cap=2048):
    want = []
    for i, t, *_ in rows:
        ids = [*ids_of(t), 0]
        for k in range(0, len(ids), cap):
            cut = ids[k : k + cap]
            want.append((i, k // cap, k, len(cut), zlib.crc32(np.asarray(cut, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= cap
    return len(seqs), -(-sum(w[3] for w in want) // cap)


def test_op8_brute(spark, tmp_path, ids_of):
    spark.createDataFrame(ROWS, DOC).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    used, least = check_packing(ROWS, op8.op8_pack(spark, str(tmp_path)).collect(), ids_of)
    assert used <= least + 1


def test_op8_tree_on_many_partitions(spark, ids_of, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        got = op8.op8_pack(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.sequence_id >> 36 for r in got}) > 16
    used, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, ids_of)
    assert used <= least * 1.05 + 1


def test_best_fit_small():
    bins, offsets, fills = packing.best_fit(np.array([5, 5, 3, 7, 2]), 10)
    assert sorted(fills.tolist()) == [2, 10, 10]
    assert len(bins) == len(offsets) == 5
    assert packing.best_fit(np.array([], np.int64), 10)[2].size == 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert op7.op7_token_planes(spark, str(tmp_path)).collect() == []
    assert op8.op8_pack(spark, str(tmp_path)).collect() == []
