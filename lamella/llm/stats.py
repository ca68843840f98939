"""Statistics of documents that the quality rules and the quality classifier read. Texts only: no ids, sources or labels.

Words, windows and lines are compared by 64-bit hashes, all of a batch together: of k different ones two are taken for
equal with a chance of k^2 / 2^65. A batch of 4 MB has about 700,000, which makes 1.3e-8; over the 25 million batches of
100 TB, a third of one count is expected to be off.

Results: null and empty texts have no words; all their counts and ratios are 0. Very long texts are read whole. Rows that
repeat, or share an id, are counted each by itself. All columns of the input are kept, and the new one gets a name that
none of them has. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lamella.llm import common
from lamella.llm.words import ODD, hash_strings, mix, plain_texts, split_words, windows

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols_per_word", "upper_per_letter", "digits_per_char", "exclaims_per_word", "stops_per_word", "bars_per_word", "nonascii_per_char", "chars_per_word", "distinct_words", "repeated_words", "dup_lines", "words_per_line", "log_words", "longest_word", "letters_per_char", "echoed_words")
LOWER, UPPER, DIGIT, SPACE, SYMBOL, BAR, EXCLAIM, STOP, HIGH, TAIL, OTHER = range(11)


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    for cls, chars in ((LOWER, "abcdefghijklmnopqrstuvwxyz"), (UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"), (SPACE, " \t\n\v\f\r"), (SYMBOL, "#*$%&<>"), (BAR, "|"), (EXCLAIM, "!?"), (STOP, ".,;:")):
        t[list(chars.encode())] = cls
    t[0x80:0xC0], t[0xC0:] = TAIL, HIGH  # a code point is any byte but a TAIL
    return t


CLASS = _classes()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds, without an array of running sums."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][full], dtype=np.int64)
    return out


def _firsts(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (owner, hash) and where a new pair begins in it."""
    with np.errstate(over="ignore"):
        key = mix(h + owner.astype(np.uint64) * ODD)
    order = np.argsort(key, kind="stable")
    s = key[order]
    return order, np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS (int64) and RATIOS (float64) of each text."""
    n = len(texts)
    texts = plain_texts(texts)
    words, bounds = split_words(texts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n), n_words)
    letters_in_word = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    h = hash_strings(words)
    echoed = np.zeros(len(h), bool)
    echoed[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order, new = _firsts(h, owner)
    distinct = np.bincount(owner[order[new]], minlength=n)

    fives = windows(h, WINDOW)
    whole = owner[: len(fives)] == owner[WINDOW - 1 :] if len(fives) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    order, new = _firsts(fives[at], owner[at])
    alone = new & np.r_[new[1:], True] if len(new) else new
    begins = np.zeros(len(h) + 1, np.int64)
    twice = at[order[~alone]]
    begins[twice] += 1
    np.subtract.at(begins, twice + WINDOW, 1)
    repeated = _sums(np.cumsum(begins[:-1]) > 0, bounds)

    lists = pc.split_pattern(texts, "\n")
    at = np.asarray(lists.offsets, np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    pair = (np.repeat(np.arange(n), np.diff(at)) * max(1, len(coded.dictionary)) + codes)[worded]
    n_lines = _sums(worded, at - at[0])
    seen, counts = np.unique(pair, return_counts=True)
    dup_lines = np.bincount(seen // max(1, len(coded.dictionary)), weights=counts - 1, minlength=n).astype(np.int64)

    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    cls = CLASS[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    c = [_sums(cls == k, at - at[0]) for k in range(11)]
    points = np.diff(at) - c[TAIL]
    word_chars = _sums(letters_in_word, bounds)
    longest = np.zeros(n)
    full = n_words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(letters_in_word, bounds[:-1][full])

    def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    letters = c[LOWER] + c[UPPER]
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": c[SYMBOL] + c[BAR],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "symbols_per_word": per(c[SYMBOL], n_words),
        "upper_per_letter": per(c[UPPER], letters),
        "digits_per_char": per(c[DIGIT], points),
        "exclaims_per_word": per(c[EXCLAIM], n_words),
        "stops_per_word": per(c[STOP], n_words),
        "bars_per_word": per(c[BAR], n_words),
        "nonascii_per_char": per(c[HIGH], points),
        "chars_per_word": per(word_chars, n_words),
        "distinct_words": per(distinct, n_words),
        "repeated_words": per(repeated, n_words),
        "dup_lines": per(dup_lines, n_lines),
        "words_per_line": np.log1p(per(n_words, n_lines)),
        "log_words": np.log1p(n_words),
        "longest_word": np.log1p(longest),
        "letters_per_char": per(letters + c[HIGH], points),
        "echoed_words": per(_sums(echoed, bounds), n_words),
    }


def with_statistics(df: DataFrame, text_col: str = "text", counts: bool = True) -> DataFrame:
    """df with a struct column named as no other column: the last one. Narrow: no shuffle."""
    names = (*COUNTS, *RATIOS) if counts else RATIOS
    taken = {c.lower() for c in df.columns}
    struct = next(x for x in ("stats", *(f"stats_{k}" for k in range(len(taken) + 1))) if x not in taken)
    at = df.columns.index(text_col)

    def run(batches):
        for b in common.lean(batches):
            s = statistics(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([pa.array(s[k]) for k in names], names=list(names))], names=[*b.schema.names, struct])

    from pyspark.sql import types as T

    kinds = T.StructType([T.StructField(k, T.LongType() if k in COUNTS else T.DoubleType()) for k in names])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(struct, kinds)]))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text and quality of at most `most` label rows, chosen by the hash of doc_id: a sample with a fixed bound, which is broadcast.

    Rows of docs that share a doc_id all come; learners keep one of them, that with the least statistics.
    """
    from pyspark.sql import functions as F

    rows = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
