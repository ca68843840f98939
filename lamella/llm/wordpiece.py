"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest piece of the vocabulary at the start of a word, then the longest continuation piece,
and so on; a word that cannot be covered is one unknown token. The automaton is a trie of the vocabulary in which each
node has a failure link and the number of pieces that are popped on the way along it. Each character is followed once
and each link pops at least one piece, so a word costs time linear in its length, and no piece is built.

Results: null and empty texts have no words and no tokens. A word of any length costs time linear in it; a text of any
length is one row of a batch. Rows that repeat, or share an id, are counted each by itself; a null id stays null. Columns
other than id and text are not read, so clashing names do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.words import split_words

NONE = -1


class Counter:
    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: the start of a word; node 1: after a piece
        ends = set()
        for root, pieces in ((0, starts), (1, continuations)):
            for p in pieces:
                at = root
                for c in p:
                    at = self.next[at].setdefault(c, len(self.next))
                    if at == len(self.next):
                        self.next.append({})
                if at != root:
                    ends.add(at)
        self.link, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            v = queue.popleft()
            for c, u in self.next[v].items():
                if u in ends:
                    self.link[u], self.popped[u] = 1, 1
                else:
                    z, n = self.link[v], self.popped[v]
                    while z != NONE and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z != NONE:
                        self.link[u], self.popped[u] = self.next[z][c], n
                queue.append(u)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it is unknown."""
        step, link, popped = self.next, self.link, self.popped
        at, n = 0, 0
        for c in word:
            while (to := step[at].get(c, NONE)) == NONE:
                n += popped[at]
                at = link[at]
                if at == NONE:
                    return 0
            at = to
        while at != 1:
            n += popped[at]
            at = link[at]
            if at == NONE:
                return 0
        return n


def pieces_of(path: str) -> list[str]:
    """The texts of a byte-level BPE file's tokens, without marks of word ends. Tokens that are no whole characters are left out."""
    from tokenizers import Tokenizer, decoders

    tok = Tokenizer.from_file(path)
    plain = decoders.ByteLevel()
    out = set()
    for t in tok.get_vocab(with_added_tokens=False):
        text = plain.decode([t.removesuffix("</w>")])
        if text and "\ufffd" not in text:
            out.add(text)
    return sorted(out)


_counters: dict[str, tuple[Counter, dict[str, int]]] = {}
REMEMBERED = 200_000


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_tokens and n_unknown, for each row of docs; words in lower case, pieces of the file at `path`. Narrow."""

    def run(batches):
        if path not in _counters:
            pieces = pieces_of(path)
            _counters[path] = Counter(pieces, pieces), {}
        counter, memo = _counters[path]
        for b in common.lean(batches):
            words, bounds = split_words(b.column(1))
            coded = pc.utf8_lower(words).dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(memo) > REMEMBERED:
                memo.clear()
            for w in distinct:
                if w not in memo:
                    memo[w] = counter.count(w)
            each = np.fromiter(map(memo.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
            tokens, unknown = (np.r_[0, np.cumsum(x)] for x in (np.maximum(each, 1), each == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.diff(x), pa.int64()) for x in (bounds, tokens[bounds], unknown[bounds]))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
