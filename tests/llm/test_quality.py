import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from lamella.llm import classifier, op1, op5, rules, stats

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("stats", T.StringType()), T.StructField("score", T.StringType())])
LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e a b c d e a b"), (5, "x\nx\n \n \ny\nx"), (6, "é|#*$% <>&\x1c ü\x0bz"), (7, "w " * 3000), (8, "one"), (None, "no id but ten words in this text as it is"), (8, "one"), (9, "line one\r\nline one\n")]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    hit = {j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_brute_force():
    import pyarrow.parquet as pq

    texts = [t for _, t in ODD] + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    got = stats.statistics(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in stats.COUNTS) == brute_counts(t), t
    assert all(np.isfinite(v).all() for v in got.values())
    assert all(len(v) == 0 for v in stats.statistics(pa.array([], pa.string())).values())


def write(spark, path, docs, labels):
    spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op1.op1_quality(spark, sf).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([y == p for _, y, p in out]) > 0.95
    low, high = ([s for s, y, _ in out if y == k] for k in (0, 1))
    assert np.mean([(a < b) + 0.5 * (a == b) for a in low for b in high]) > 0.97


def test_op5_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5.op5_rules(spark, sf).collect()
    for r in got:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, truth[r.doc_id]) for r in got if r.doc_id in truth and not r.base_failed]
    assert np.mean([k == bool(y) for k, y in judged]) > 0.97
    assert np.mean([k for k, y in judged if y]) > 0.99


def sample(sf="/root/testdata/sf0.01"):
    """Texts by doc_id and labels, read without Spark."""
    import pyarrow.parquet as pq

    d, y = pq.read_table(f"{sf}/documents.parquet"), pq.read_table(f"{sf}/labels.parquet")
    return dict(zip(d["doc_id"].to_pylist(), d["text"].to_pylist(), strict=True)), dict(zip(y["doc_id"].to_pylist(), y["quality"].to_pylist(), strict=True))


def test_normal_equations_equal_one_solve_of_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    texts, quality = sample(sf)
    learnt = sorted(i for i in quality if i in texts and zlib.crc32(str(i).encode()) % 5)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.fit(spark.read.parquet(f"{sf}/documents.parquet").repartition(7), labels.where(~op1.held_out(labels.doc_id)))
    one = stats.statistics(pa.array([texts[i] for i in learnt], pa.string()))
    x = np.column_stack([one[k] for k in stats.RATIOS])
    y = np.asarray([quality[i] for i in learnt], float)
    assert np.allclose(model.fourier.mean, x.mean(0)) and np.allclose(model.fourier.scale, x.std(0) + 1e-6)
    r = np.random.default_rng(classifier.SEED)
    w = r.normal(size=(x.shape[1], classifier.FEATURES)) / (classifier.WIDTH * x.shape[1] ** 0.5)
    phase = r.uniform(0, 2 * np.pi, classifier.FEATURES)
    z = np.cos(np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8) @ w + phase) * (2 / classifier.FEATURES) ** 0.5
    z = np.column_stack([np.ones(len(z)), z])
    ridge = np.sqrt(np.r_[0, np.full(classifier.FEATURES, classifier.RIDGE * len(z) / classifier.FEATURES)] + 1e-9)
    want = np.linalg.lstsq(np.vstack([z, np.diag(ridge)]), np.r_[y, np.zeros(len(ridge))], rcond=None)[0]
    assert np.allclose(model.weights, want, rtol=1e-4, atol=1e-5)
    assert np.allclose(z @ model.weights, model.fourier(x) @ model.weights)


def test_isotonic_equals_the_minimax_formula():
    r = np.random.default_rng(8)
    for _ in range(50):
        n = r.integers(1, 9, 12).astype(float)
        p = np.floor(r.uniform(size=12) * (n + 1))
        best = [max(min(p[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        x, y = classifier.pool(np.arange(12.0), p, n)
        assert np.allclose(sorted(set(np.round(best, 9))), sorted(set(np.round(y, 9))))


def test_kept_equals_the_rules_row_by_row(spark):
    """The verdict of the query against the list of rules walked in Python."""
    sf = "/root/testdata/sf0.01"
    texts, _ = sample(sf)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = rules.learn_rules(docs, labels)
    assert found
    for r in op5.op5_rules(spark, sf).collect():
        own = {k: float(v[0]) for k, v in stats.statistics(pa.array([texts[r.doc_id]], pa.string())).items()}
        failed = any(all((own[t.stat] > t.threshold) == t.above for t in rule) for rule in found)
        assert r.kept == (not r.base_failed and not failed)


def test_rules_judge_labels_they_have_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    found = rules.learn_rules(docs, seen)
    rows, _, failed, kept = rules.judged(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), found)
    got = [(r.quality, r.kept) for r in rows.select("quality", failed.alias("failed"), kept.alias("kept")).collect() if not r.failed]
    assert len(got) > 300 and np.mean([k for y, k in got if y]) > 0.98
    assert np.mean([not k for y, k in got if not y]) > 0.85


def test_rules_are_learned_and_ordered():
    r = np.random.default_rng(0)
    x = {k: r.uniform(size=3000) for k in stats.RATIOS}
    bad = (x["bars_per_word"] > 0.8) | ((x["dup_lines"] > 0.7) & (x["upper_per_letter"] <= 0.3))
    found = rules.learn(x, bad, r.uniform(size=3000) < 1 / 3)
    got = np.zeros(3000, bool)
    for rule in found:
        got |= rules.covered(rule, x, 3000)
    assert np.mean(got == bad) > 0.97 and 2 <= len(found) <= 12
    assert rules.learn(x, np.zeros(3000, bool), np.zeros(3000, bool)) == []


def test_isotonic():
    x, y = classifier.pool(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    assert y.tolist() == [0, 0.5, pytest.approx(2 / 3)]


@pytest.mark.parametrize("labels", [[], [(4, 1, 0), (7, 1, 0)], [(None, 0, 1), (4, None, None)], [(4, 1, 0), (7, 0, 0), (7, 0, 0), (99, 1, 1)]])
def test_odd_rows_and_few_labels(spark, tmp_path, labels):
    sf = write(spark, tmp_path, ODD, labels)
    assert sorted([r.doc_id for r in op1.op1_quality(spark, sf).collect()], key=str) == sorted([i for i, _ in ODD], key=str)
    got = op5.op5_rules(spark, sf).collect()
    assert sorted([(r.doc_id, r.n_words) for r in got], key=str) == sorted([(i, brute_counts(t)[0]) for i, t in ODD], key=str)


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, [], [])
    assert op1.op1_quality(spark, sf).collect() == [] and op5.op5_rules(spark, sf).collect() == []
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in op5.op5_rules(spark, sf).collect() if r.kept}
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = corpus_pipeline.quality_classifier(spark, one, sf)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} <= kept
    three = corpus_pipeline.near_dedup(spark, two, sf)
    assert three.columns == docs.columns
    packed = corpus_pipeline.best_fit_packing(spark, three, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in three.collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_each_stage_equals_brute_force(spark):
    """Every stage on its own input, decided row by row without its operator's Spark code."""
    import public_tokenizers
    from test_neardup import brute
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, _ = sample(sf)
    numbers = {i: {k: float(v[0]) for k, v in stats.statistics(pa.array([t], pa.string())).items()} for i, t in texts.items()}

    found = rules.learn_rules(docs, labels)
    want = set()
    for i, t in texts.items():
        n_words, _, _, _, repeats = brute_counts(t)
        if n_words >= 10 and 100 * repeats <= 20 * n_words and not any(all((numbers[i][x.stat] > x.threshold) == x.above for x in rule) for rule in found):
            want.add(i)
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == want

    model = classifier.fit(one, labels.where(~op1.held_out(labels.doc_id)))
    want = {i for i in want if model.score(np.asarray([[numbers[i][k] for k in stats.RATIOS]]))[0] >= 0.3}
    two = corpus_pipeline.quality_classifier(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == want

    want = {i for i, _, c in brute([(i, texts[i]) for i in sorted(want)], 5, 80) if i == c}
    three = corpus_pipeline.near_dedup(spark, two, sf)
    assert {r.doc_id for r in three.collect()} == want

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = {}, {}
    for r in corpus_pipeline.best_fit_packing(spark, three, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == want
    for i, rows in pieces.items():
        ids = [*plain.encode(texts[i], add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert sorted(rows) == [(k, 2048 * k, len(c), zlib.crc32(np.asarray(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for rows in bins.values():
        ends = np.cumsum([n for _, n in sorted(rows)])
        assert [o for o, _ in sorted(rows)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(n for rows in bins.values() for _, n in rows)
    assert len(bins) <= -(-total // 2048) + 2


def test_pipeline_on_clashing_columns(spark, tmp_path):
    sf = write(spark, tmp_path, ODD, [(4, 1, 0), (7, 0, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "stats", "score"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= 1
