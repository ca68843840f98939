import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lamella.llm import chat, op3, op4, op6, wordpiece

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("part", T.IntegerType())])
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\", "<\\/s>", "<</s>", "</s", "[/INST", "[", "<s><s>", "[\\INST]", "é</s>日本", "", None, "a\nb", "\\</s>\\[INST]\\"]


def rows_of(seed, n):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", "system", None, "</s>x", "a\\"]), r.choice(NASTY), 1) for _ in range(n)]


def brute(rows):
    key = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, rs in by.items():
        turns, loss = "", ""
        for _, _, role, t, *_ in sorted(rs, key=lambda r: (key(r[1]), text(r[2]), text(r[3]))):
            turns += f"{role or ''}\n{t or ''}\n"
            loss += (t or "") if role == "assistant" else ""
        out.append((conv, len(rs), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rows = rows_of(1, 120)
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op6.op6_chat(spark, str(tmp_path)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows + op6.PLANTED)
    planted = next(r for r in got if r.conv_id == -1)
    formatted = chat.format_chat(spark.createDataFrame(op6.PLANTED, "conv_id long, turn long, role string, text string")).first().formatted
    assert planted.formatted_chars == len(formatted) and len(chat.parse(formatted)) == 2


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_long_conversations_in_parts(spark, limit):
    rows = rows_of(2, 200)
    parts = chat.format_chat(spark.createDataFrame(rows, CONV), limit)
    got = sorted((tuple(r)[:5] for r in parts.mapInArrow(op6.read_back, op6.SCHEMA).collect()), key=str)
    assert got == brute(rows)
    assert parts.count() > 4


def test_parts_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = rows_of(3, 100)
        for limit in (4, 10**6):
            parts = chat.format_chat(spark.createDataFrame(rows, CONV), limit)
            assert sorted((tuple(r)[:5] for r in parts.mapInArrow(op6.read_back, op6.SCHEMA).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_cuts_keep_characters_and_control_strings():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["</s>", "[INST]", "é", "日", "a", "<", "[/INST]", "\\", "<s>", "/"]) for _ in range(r.randrange(0, 30)))
        raw = text.encode()
        for limit in (1, 5, 9):
            cuts = chat._cuts(np.frombuffer(raw, np.uint8), limit)
            pieces = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
            whole, parts = (chat.escape(pa.array(x)).to_pylist() for x in ([text], pieces or [""]))
            assert "".join(parts) == whole[0]


def test_a_turn_of_256_megabytes_in_a_worker_of_one_gigabyte():
    code = """
import resource, sys, hashlib, numpy as np, pyarrow as pa
from lamella.llm import chat, op6
n = 256 << 20
data = np.full(n, ord("a"), np.uint8)
data[::1000003] = ord("[")
data[5 : 5 + 4 << 20 : 4 << 20] = ord("<")
buffer = pa.py_buffer(data)
text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.array([0, n]).buffers()[1], buffer])
batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array(["assistant"]), text], names=["conv_id", "role", "text"])
rows = list(op6.read_back(chat._format(iter([batch]), chat.PART)))
r = rows[0].to_pylist()[0]
assert r["n_turns"] == 1 and r["loss_chars"] == n and r["loss_sha256"] == hashlib.sha256(data).hexdigest()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) < 1000


def test_a_conversation_minus_one_of_the_table(spark, tmp_path):
    rows = [(-1, 2, "user", "more", 1), (-1, 0, "assistant", "first", 1)]
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op6.op6_chat(spark, str(tmp_path)).collect()
    assert [tuple(r)[:5] for r in got] == brute(rows + op6.PLANTED)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in op6.op6_chat(spark, str(tmp_path)).collect()] == [-1]


def greedy(word, starts, continuations):
    n, at, pieces = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at, pieces = n + 1, end, continuations
    return n


def test_automaton_equals_greedy():
    r = random.Random(4)
    for _ in range(300):
        starts, cont = ({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 14))} for _ in range(2))
        c = wordpiece.Counter(starts, cont)
        for _ in range(40):
            w = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randrange(1, 20)))
            assert c.count(w) == greedy(w, starts, cont), (w, starts, cont)


def test_counts_query(spark, tmp_path):
    doc = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
    rows = [(1, "The cat sat. 日本語 !!"), (2, None), (3, ""), (None, "x" * 9000), (1, "The cat sat. 日本語 !!"), (4, " \t\n")]
    spark.createDataFrame([(*x, "c") for x in rows], doc).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = set(wordpiece.pieces_of(op3.vocabulary()))
    want = []
    for i, t in rows:
        n = [greedy(w, pieces, pieces) for w in (t or "").lower().split()]
        want.append((i, len(n), sum(max(1, x) for x in n), sum(x == 0 for x in n)))
    assert sorted(map(str, map(tuple, op4.op4_token_counts(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
