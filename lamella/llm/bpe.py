"""BPE encoding and decoding by tree concatenation.

Every text longer than LEAF characters is cut in leaves of that length, at any position, within words as well. All leaves
of a batch are encoded at once; leaves of a long batch by several threads. Then neighbours are joined pairwise, level by
level, until each text is one part. For a join the text around it, the window, is encoded again: at first WINDOW characters
or a little more on each side, then twice as many each time, until it shares a token with the left part and one with the
right part, both of the same id and at the same bytes. The result is the left part up to its token, the window between the
two, and the right part from its token on.

Why that is exact: a merge-order encoding is the only sequence whose neighbours are compatible, and all neighbours of the
result stand side by side in the left part, the window or the right part. Borders of the split pattern hold as well: the
piece ("pretoken") of the shared left token begins as in the left part and ends as in the window, that of the right one
begins as in the window and ends as in the right part. The only pattern that looks ahead, the contractions, are single
tokens (checked when a file is opened; files of another kind are encoded by the library alone). White space belongs to no
token, so bytes are counted without it. No cut lies before a character that could compose with the one before it, nor
within an added token.

Leaves and windows are encoded by the library, each distinct word once: a worker remembers words it has met, and Arrow
gathers their ids in the order of the text.

Results: null and empty texts have no tokens. Ids equal those of the library's encode(add_special_tokens=False), for very
long texts with or without spaces too; memory grows with the text and its ids. Rows that repeat, or share an id, are
encoded each by itself; columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lamella.llm import common
from lamella.llm.words import plain_texts

#: Characters of a leaf.
LEAF = 1024
#: Leaf length for operators that are not asked for the tree: it only bounds what the library holds of one text.
LONG = 1 << 20
#: Characters of a window on each side of a join, at first.
WINDOW = 12
#: Characters in a batch from which the library encodes with several threads.
THREADED = 1 << 20
#: Characters that the library is given at once.
GIVEN = 1 << 20
#: A worker remembers between once and twice so many distinct units, those met last, of at most SHORT characters. Results do not depend on it.
REMEMBERED, SHORT = 100_000, 64
#: Texts without these are lower-cased and cut at the borders of letters by Arrow, as the library would do it: NFC leaves
#: their characters as they are, and lower case does not depend on neighbours. All others are cut at spaces alone.
NOT_PLAIN = "[^ -~\\n¡-įı-ɏ]|<\\|"
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the split pattern of the vocabulary file
PLAIN_ASCII = re.compile(r"[ -~\n]*")


class Part:
    """The encoding of text[a:b], as arrays of ids one after the other."""

    __slots__ = ("a", "b", "ids")

    def __init__(self, a: int, b: int, ids: list[np.ndarray]):
        self.a, self.b, self.ids = a, b, ids

    def last(self, n: int) -> list[int]:
        """The last n ids, or more, if there are."""
        k, have = len(self.ids), 0
        while k and have < n:
            k -= 1
            have += len(self.ids[k])
        return np.concatenate(self.ids[k:])[-n:].tolist() if k < len(self.ids) else []

    def first(self, n: int) -> list[int]:
        k = have = 0
        while k < len(self.ids) and have < n:
            have += len(self.ids[k])
            k += 1
        return np.concatenate(self.ids[:k])[:n].tolist() if k else []

    def without_last(self, n: int) -> list[np.ndarray]:
        out = self.ids
        while n and out:
            if n < len(out[-1]):
                out[-1] = out[-1][: len(out[-1]) - n]
                break
            n -= len(out.pop())
        return out

    def without_first(self, n: int) -> list[np.ndarray]:
        k = 0
        while n and k < len(self.ids):
            if n < len(self.ids[k]):
                self.ids[k] = self.ids[k][n:]
                break
            n -= len(self.ids[k])
            k += 1
        return self.ids[k:]


class Memo:
    """Remembers values by key in two generations, so that keys met often stay and memory has a bound."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of distinct keys; learn gives those not remembered."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young = self.young
        out = list(map(young.get, keys))
        gone = [k for k, v in enumerate(out) if v is None]
        if gone and self.old:
            get, left = self.old.get, []
            for k in gone:
                v = get(keys[k])
                if v is None:
                    left.append(k)
                else:
                    out[k] = young[keys[k]] = v
            gone = left
        new = [keys[k] for k in gone]
        for k, key, v in zip(gone, new, learn(new) if new else [], strict=True):
            out[k] = v
            if len(key) <= SHORT:
                young[key] = v
        return out


def _bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


@contextlib.contextmanager
def _threads(characters: int):
    """The library reads the variable at each call: many leaves are encoded by several threads, few by this one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if characters >= THREADED else "false"
    try:
        yield
    finally:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"


class Codec:
    """A tokenizer file's encoder and decoder."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("RAYON_NUM_THREADS", "4")
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf = leaf
        model = spec["model"]
        whole = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("ignore_merges")
        self.splits = whole and self._drops_space(spec)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([self.tok.id_to_token(k) or "" for k in range(size)], pa.string())
        pattern = (((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex")
        suffix = model.get("end_of_word_suffix") or ""
        #: Which ids end a pretoken; known only for vocabularies that mark word ends.
        self.ends = np.asarray([bool(suffix) and t.endswith(suffix) for t in self.tokens.to_pylist()]) if self.splits and pattern == PRETOKENS and suffix else None
        self.find = regex.compile(PRETOKENS).findall
        self.safe = regex.compile(r"[^\p{M}\u1100-\u11FF\uD7B0-\uD7FF\U00016D40-\U00016D7F]").match
        self.units = Memo()
        #: Bytes of text that a token stands for: its characters each stand for one, but for the mark of a word's end.
        added = {x["id"]: len(x["content"].encode()) for x in spec["added_tokens"]}
        self.size = [added.get(k, len(t.removesuffix(suffix))) for k, t in enumerate(self.tokens.to_pylist())]
        contents = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.reach = max(map(len, contents), default=0)
        vocabulary = model.get("vocab") or {}
        self.joins = self.ends is not None and not any(" " in x or x.endswith("'") for x in contents) and all(c + suffix in vocabulary for c in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """Whether text may be cut at spaces and line ends: the pre-tokenizer removes them and no pattern crosses them."""
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        plain = all(n["type"] in ("NFC", "Lowercase", "Replace") for n in (spec.get("normalizer") or {}).get("normalizers", []))
        strips = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in spec["added_tokens"])
        return plain and not strips and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """The library's ids of texts, some at a time."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            n, e = 0, k
            while e < len(texts) and (e == k or n + len(texts[e]) <= GIVEN):
                n += len(texts[e])
                e += 1
            out += [_bytes(x.ids) for x in self.tok.encode_batch_fast(texts[k:e], add_special_tokens=False)]
            k = e
        return out

    def _learn_pretokens(self, pieces: list[str]) -> list[bytes]:
        """Many pretokens as one text, cut at the ids that end a word."""
        out: list[bytes] = []
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += [_bytes(e.ids) for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _learn_plain(self, units: list[str]) -> list[bytes]:
        """Units of plain texts, in lower case: most are one run of letters, which is one pretoken."""
        whole = [u for u in units if len(u) <= SHORT and u.isalpha()]
        values = dict(zip(whole, self._learn_pretokens(whole), strict=True))
        rest = [u for u in units if u not in values]
        found = [self.find(u) for u in rest]
        distinct = list({p for f in found for p in f if len(p) <= SHORT})
        long = list({p for f in found for p in f if len(p) > SHORT})
        get = dict(zip(distinct + long, self._learn_pretokens(distinct) + self._encoded(long), strict=True)).__getitem__
        values.update((u, b"".join(map(get, f))) for u, f in zip(rest, found, strict=True))
        return list(map(values.__getitem__, units))

    def _gather(self, lists: pa.Array, learn: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of units, and how many each list has."""
        flat, bounds = lists.flatten().dictionary_encode(), np.asarray(lists.offsets, np.int64)
        values = self.units.values(flat.dictionary.to_numpy(zero_copy_only=False).tolist(), learn)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ragged = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], pa.Array.from_buffers(pa.uint32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(values))]))
        ids = ragged.take(flat.indices).flatten().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes[flat.indices.to_numpy(zero_copy_only=False)])] if len(flat) else np.zeros(1, np.int64)
        return ids, np.diff(ends[bounds - bounds[0]])

    def batch(self, texts: pa.Array, joins: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (unsigned 32-bit) and where each text's begin, with the end of the last. Null is empty.

        joins gets the number of joins of each text.
        """
        texts = plain_texts(texts)
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived lists without cycles
        try:
            with _threads(pc.sum(pc.utf8_length(texts)).as_py() or 0):
                return self._tree(texts, [] if joins is None else joins)
        finally:
            if collects:
                gc.enable()

    def _tree(self, texts: pa.Array, joins: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not self.joins:
            joins += [0] * len(texts)
            return self._flat(texts)
        long = np.flatnonzero(pc.utf8_length(texts).to_numpy(zero_copy_only=False) > self.leaf)
        each = np.zeros(len(texts), np.int64)
        if not len(long):
            joins += each.tolist()
            return self._flat(texts)
        whole = texts.take(pa.array(long)).to_pylist()
        cuts = [self._cuts(t) for t in whole]
        leaves = [t[a:b] for t, c in zip(whole, cuts, strict=True) for a, b in zip(c, c[1:], strict=False)]
        ids, at = self._flat(pa.array(leaves, pa.large_string()))
        parts, k = [], 0
        for c in cuts:
            n = len(c) - 1
            parts.append([Part(a, b, [ids[x:y]]) for a, b, x, y in zip(c, c[1:], at[k : k + n], at[k + 1 : k + n + 1], strict=False)])
            k += n
        while any(len(p) > 1 for p in parts):
            self._join([(t, x, y) for t, p in zip(whole, parts, strict=True) for x, y in zip(p[::2], p[1::2], strict=False)])
            parts = [p[::2] for p in parts]
        each[long] = [len(c) - 2 for c in cuts]
        joins += each.tolist()
        short = np.delete(np.arange(len(texts)), long)
        ids, at = self._flat(texts.take(pa.array(short)))
        found: list = [None] * len(texts)
        for k, a, b in zip(short.tolist(), at, at[1:], strict=False):
            found[k] = [ids[a:b]]
        for k, p in zip(long.tolist(), parts, strict=True):
            found[k] = p[0].ids
        sizes = [sum(map(len, x)) for x in found]
        return np.concatenate([y for x in found for y in x]).astype("<u4", copy=False), np.r_[0, np.cumsum(sizes)].astype(np.int64)

    def _apart(self, text: str, k: int, least: int) -> int:
        """The last position in least..k that is not within an added token, and where no character composes with the one before."""
        if self.added:
            for x in self.added.finditer(text, max(0, k - self.reach), min(len(text), k + self.reach)):
                if x.start() < k < x.end():
                    k = max(least, x.start())
                    break
        while k > least and k < len(text) and text[k] >= "\u0300" and not self.safe(text[k]):
            k -= 1
        return k

    def _cuts(self, text: str) -> list[int]:
        out = [0]
        for k in range(self.leaf, len(text), self.leaf):
            at = self._apart(text, k, out[-1])
            if at > out[-1]:
                out.append(at)
        return [*out, len(text)]

    def _length(self, text: str) -> int:
        """Bytes of the normalized text without white space."""
        if not PLAIN_ASCII.fullmatch(text):
            text = self.tok.normalizer.normalize_str(text)
            return len(text.replace(" ", "").encode())
        return len(text) - text.count(" ") - text.count("\n")

    def _begin(self, text: str, left: Part, width: int) -> int:
        """Where a window begins: at a space, else at a token of the left part, else anywhere."""
        m = left.b
        if m - width <= left.a:
            return left.a
        k = text.rfind(" ", max(left.a, m - 4 * width), m - width)
        if k >= 0:
            return k
        tail = text[max(left.a, m - 4 * width) : m]
        if PLAIN_ASCII.fullmatch(tail) and " " not in tail and "\n" not in tail:
            back = 0
            for t in reversed(left.last(2 * width)):
                back += self.size[t]
                if back >= width:
                    break
            if width <= back <= len(tail):
                return m - back
        return self._apart(text, m - width, left.a)

    def _end(self, text: str, right: Part, width: int) -> int:
        m = right.a
        if m + width >= right.b:
            return right.b
        k = text.find(" ", m + width, min(right.b, m + 4 * width))
        if k < 0:
            k = self._apart(text, m + width, m)
        return k if k > m else right.b

    def _join(self, open_: list[tuple[str, Part, Part]]) -> None:
        """Joins the parts of each pair into its left one. The windows of all open joins are encoded together."""
        width = WINDOW
        while open_:
            spans = [(self._begin(t, x, width), self._end(t, y, width)) for t, x, y in open_]
            ids, at = self._flat(pa.array([t[a:b] for (t, _, _), (a, b) in zip(open_, spans, strict=True)], pa.large_string()))
            flat, at = ids.tolist(), at.tolist()
            left_open = []
            for k, (job, (a, b)) in enumerate(zip(open_, spans, strict=True)):
                if not self._agreed(*job, a, b, flat[at[k] : at[k + 1]]):
                    left_open.append(job)
            open_ = left_open
            width *= 2

    def _agreed(self, text: str, left: Part, right: Part, begin: int, end: int, window: list[int]) -> bool:
        size = self.size
        middle = self._length(text[begin : left.b])
        ends, at = [], -middle
        for t in window:
            at += size[t]
            ends.append(at)
        n = len(window)
        first, drop = 0, None  # of the window; of the left part
        if begin > left.a:
            own, at, k = left.last(n + 4), 0, n - 1
            for x in range(len(own) - 1, -1, -1):
                while k >= 0 and ends[k] > at:
                    k -= 1
                if k < 0:
                    return False
                if ends[k] == at and window[k] == own[x]:
                    first, drop = k + 1, len(own) - 1 - x
                    break
                at -= size[own[x]]
            if drop is None:
                return False
        last, skip = n, None
        if end < right.b:
            own, at, k = right.first(n + 4), 0, first
            for x, t in enumerate(own):
                while k < n and ends[k] - size[window[k]] < at:
                    k += 1
                if k == n:
                    return False
                if ends[k] - size[window[k]] == at and window[k] == t:
                    last, skip = k, x
                    break
                at += size[t]
            if skip is None:
                return False
        before = left.without_last(drop) if drop is not None else []
        after = right.without_first(skip) if skip is not None else []
        left.ids = [*before, np.asarray(window[first:last], "<u4"), *after]
        left.b = right.b
        return True

    def _flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As batch, without cutting the texts at other places than the tokenizer does."""
        texts = plain_texts(texts)
        if not self.splits:
            values = [e.ids for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.asarray([i for v in values for i in v], "<u4"), np.r_[0, np.cumsum(list(map(len, values)))].astype(np.int64)
        kinds = np.full(len(texts), 2)
        if self.ends is not None:
            plain = pc.invert(pc.match_substring_regex(texts, NOT_PLAIN)).to_numpy(zero_copy_only=False)
            kinds = np.where(plain, pc.match_substring(texts, "'").to_numpy(zero_copy_only=False).astype(int), 2)
        ids, counts = [], np.zeros(len(texts), np.int64)
        order = [np.flatnonzero(kinds == k) for k in range(3)]
        for kind, at in enumerate(order):
            if not len(at):
                continue
            part = texts.take(pa.array(at))
            if kind < 2:
                part = pc.replace_substring_regex(pc.utf8_lower(part), (r"[^\s\p{L}]+", PRETOKENS)[kind], r" \0 ")
            found, counts[at] = self._gather(pc.split_pattern(pc.replace_substring(part, "\n", " "), " "), self._encoded if kind == 2 else self._learn_plain)
            ids.append(found)
        bounds = np.r_[0, np.cumsum(counts)]
        if len(ids) == 1:
            return ids[0].astype("<u4", copy=False), bounds
        shuffled = np.concatenate(order)
        lists = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(counts[shuffled])], pa.array(np.concatenate(ids) if ids else np.zeros(0, "<u4")))
        return lists.take(pa.array(np.argsort(shuffled))).flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), bounds

    def id_bytes(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, at = self.batch(texts)
        raw, cuts = memoryview(ids.tobytes()), (4 * at).tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str | None) -> list[int]:
        return self.batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts of many id lists. Without a decoder the library joins tokens by a space; Arrow does the same at once."""
        if self.tok.decoder is not None:
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, leaf: int = LONG) -> Codec:
    """One codec for each worker process."""
    if (path, leaf) not in _codecs:
        _codecs[path, leaf] = Codec(path, leaf)
    return _codecs[path, leaf]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Columns id_col, ids (array of int), decoded (string) and n_joins, one row for each row of docs. Narrow: no shuffle."""

    def run(batches):
        c = codec(path, leaf)
        for b in common.lean(batches):
            joins: list[int] = []
            ids, at = c.batch(b.column(1), joins)
            flat = pa.array(ids.view(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), c.decode_batch(ids, at), pa.array(joins, pa.int64())], names=[id_col, "ids", "decoded", "n_joins"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string, n_joins long")
