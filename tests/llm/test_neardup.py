import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lamella.llm import components, neardup, op2, words

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("root", T.IntegerType())])


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """doc_id -> (set size, component), by comparing every pair."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    full = [(i, sets_of(t, size)) for i, t in rows]
    for a, (i, s) in enumerate(full):
        for j, t in full[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in full)


def near_copies(seed, bases, copies, length=60, alphabet=4000):
    r = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{r.randrange(alphabet)}" for _ in range(length)]
        rows.append(" ".join(base))
        for _ in range(copies):
            c = list(base)
            for _ in range(r.randrange(0, 5)):
                c[r.randrange(length)] = f"x{r.randrange(alphabet)}"
            rows.append(" ".join(c))
    r.shuffle(rows)
    return list(enumerate(rows))


def run(spark, tmp_path, rows, n=3):
    path = f"{tmp_path}/{random.random()}"
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC).repartition(n).write.parquet(f"{path}/documents.parquet")
    return op2.op2_minhash(spark, path)


def test_word_sets():
    texts = ["A b\x0bC\x1cd é", None, "", " \t\n", "one", "One TWO", "a b c a b c", " x  y z É É "]
    for t, s in zip(texts, words.shingle_sets(pa.array(texts), 3), strict=True):
        assert len(s) == len(sets_of(t, 3)), t
    whole = words.shingle_sets(pa.array(texts), 3)
    for a in range(len(texts)):
        for s, t in zip(words.shingle_sets(pa.array(texts)[a : a + 3], 3), whole[a:], strict=False):
            assert (s == t).all()
    assert (words.shingle_sets(pa.array(["A B c"]), 3)[0] == words.shingle_sets(pa.array(["q", " a b  C "]), 3)[1]).all()


def closure(sets, percent):
    rows = [(k, " ".join(map(str, s.tolist()))) for k, s in enumerate(sets)]
    return {i: c for i, _, c in brute(rows, 1, percent)}


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_links_within_is_exact(percent):
    r = np.random.default_rng(percent)
    for n in (2, 3, 40, 90):
        pool = np.arange(1, 80, dtype=np.uint64)
        sets = [np.sort(r.choice(pool, r.integers(30, 70), replace=False)) for _ in range(n)]
        sets += [np.sort(np.r_[s[:-2], [np.uint64(200 + k)]]).astype(np.uint64) for k, s in enumerate(sets[: n // 2])]
        sets += [np.sort(r.choice(pool, r.integers(1, 9), replace=False)) for _ in range(n)]
        got, want = neardup.links_within(sets, percent), closure(sets, percent)
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(len(sets)) for b in range(a))


def test_known_components_are_kept():
    r = np.random.default_rng(1)
    sets = [np.sort(r.choice(np.arange(60, dtype=np.uint64), 40, replace=False)) for _ in range(30)]
    known = np.arange(30)
    known[[7, 9, 20]] = 3
    known[29] = 28
    got, plain = neardup.links_within(sets, 70, known), neardup.links_within(sets, 70)
    up = {k: {k} for k in range(30)}
    for one in (known, plain):
        for k in range(30):
            x, y = up[k], up[int(one[k])]
            if x is not y:
                x |= y
                for j in y:
                    up[j] = x
    assert all((got[a] == got[b]) == (up[a] is up[b]) for a in range(30) for b in range(a))


def test_links_between_texts_of_one_form():
    """Many documents that share half their shingles, and a few near copies among them."""
    r = np.random.default_rng(2)
    form = np.arange(1, 61, dtype=np.uint64)
    sets = [np.r_[form, np.sort(r.choice(np.arange(100, 10**6), 40, replace=False)).astype(np.uint64)] for _ in range(300)]
    sets += [np.r_[s[:-3], [np.uint64(2 * 10**6 + k)]].astype(np.uint64) for k, s in enumerate(sets[:30])]
    got, want = neardup.links_within(sets, 85), closure(sets, 85)
    assert [got[a] == got[a + 300] for a in range(30)] == [True] * 30
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(len(sets)) for b in range(a))


def test_many_sets_that_are_not_alike_are_quick():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 40, 8).astype(np.uint64)) for _ in range(50_000)]
    sets[777] = np.unique(np.r_[sets[11][:-1], sets[11][-1:]])
    began = time.perf_counter()
    got = neardup.links_within(sets, 85)
    assert time.perf_counter() - began < 10
    assert got[777] == got[11] == 11 and len(np.unique(got)) == 49_999


@pytest.mark.parametrize("held", [40, 10**6])
def test_components(spark, held):
    r = random.Random(held)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    edges = chain + star + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(3, 3), (101, 100), (101, 100)]
    up = {}
    for a, b in edges:
        if a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            if x is not y:
                x |= y
                up.update(dict.fromkeys(x, x))
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long"), held).collect()}
    assert got == {k: min(x) for k, x in up.items()}
    assert components.components(spark.createDataFrame([], "u long, v long"), held).collect() == []


def test_ties_connect_exactly_the_buckets(spark):
    r = random.Random(8)
    rows = [(k, *(r.randrange(4) for _ in range(4))) for k in range(120)]
    for held in (60, 10**6):
        neardup.HELD, before = held, neardup.HELD
        try:
            edges = [tuple(x) for x in neardup.ties(spark.createDataFrame(rows, "doc_id long, c0 long, c1 long, c2 long, c3 long"), 4).collect()]
        finally:
            neardup.HELD = before
        up = {k: k for k, *_ in rows}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(4):
            for j in range(i + 1, 4):
                seen = {}
                for k, *c in rows:
                    first = seen.setdefault((c[i], c[j]), k)
                    up[max(find(k), find(first))] = min(find(k), find(first))
        want = {k: find(k) for k, *_ in rows}
        up.update({k: k for k in up})
        for a, b in edges:
            assert want[a] == want[b]
            up[max(find(a), find(b))] = min(find(a), find(b))
        assert {k: find(k) for k, *_ in rows} == want


def test_query_equals_brute_force(spark, tmp_path):
    rows = near_copies(1, 25, 7) + [(1000, ""), (1001, None), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "b " * 500), (1007, "B\tb b")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, tmp_path, rows).collect())
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("block", [200, 2000])
def test_large_clusters_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "LEAST_BLOCK", 50)
    rows = near_copies(5, 3, 40, length=50)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)
    got = sorted(map(tuple, neardup.near_duplicates(df, 3, 85, block).collect()))
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("parts", [0, 16])
def test_clusters_of_a_form_in_blocks(spark, monkeypatch, parts):
    """A cluster with many components, which pivots do not join; compared as one, and bucket by bucket."""
    monkeypatch.setattr(neardup, "LEAST_BLOCK", 50)
    monkeypatch.setattr(neardup, "PARTS", parts)
    r = random.Random(6)
    form = " ".join(f"f{k}" for k in range(40))
    rows = [form + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(80)]
    rows += [t + " again" for t in rows[:25]] + [form] * 2 + [form + " once"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], DOC)
    got = sorted(map(tuple, neardup.near_duplicates(df, 3, 85, 300).collect()))
    assert got == brute(list(enumerate(rows)), 3, 85)


def test_pipeline_setting_equals_brute_force(spark):
    """Words by five, 80 %: recall of planted near copies of all degrees, and documents, is whole."""
    rows = near_copies(9, 30, 8, length=120) + [(5000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)
    want = brute(rows, 5, 80)
    assert sorted(map(tuple, neardup.near_duplicates(df, 5, 80).collect())) == want
    left = sorted(r.doc_id for r in neardup.drop_near_duplicates(df, 5, 80).select("doc_id").collect())
    assert left == sorted(i for i, _, c in want if i == c)


def test_one_row_of_a_doc_id_stays_and_always_the_same(spark):
    rows = [(1, f"text {k} of the same id", str(k), k) for k in range(20)] + [(1, "text 0 of the same id", "0", 0)] * 2
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOC).repartition(1 + seed)).collect()
        assert [(r.doc_id, r.text, r.component_id, r.root) for r in got] == [(1, "text 0 of the same id", "0", 0)]


def test_sf_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op2.op2_minhash(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows, 3, 85)


def test_repeated_rows_nulls_and_none(spark, tmp_path):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "q r s t"), (2, "q r s t"), (None, "a b c d"), (9, "other words here now"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, tmp_path, rows).collect()), key=str)
    assert got == sorted([(5, 2, 2, False)] * 3 + [(2, 2, 2, True), (None, 2, None, True), (9, 2, 9, True), (None, 0, None, True)], key=str)
    assert run(spark, tmp_path, []).collect() == []
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted([(2, "q r s t"), (9, "other words here now"), (None, "a b c d"), (None, None)], key=str)
