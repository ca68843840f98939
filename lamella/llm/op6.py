"""Query of operator 6: all conversations formatted, and what is read back from the formatted text.

Two rows are planted as conversation -1. In a table that has a conversation -1 they are turns 0 and 1 of it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lamella.llm import chat, common

SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
#: The digests straight from the table, and the length of what the template writes.
SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, length(replace(replace(replace(replace(replace(x, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) as n
  from (select *, role || chr(1) || text as x from turns)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(n - 1 + 17))::bigint as formatted_chars
from sized group by conv_id
"""


class Digest:
    """Of one conversation; parts come in order, and nothing longer than a part is held."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.reader = chat.Reader()

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        self.chars += len(formatted)
        for what, piece in self.reader.read(formatted):
            if what == "turn":
                self.n += 1
            self.turns.update(piece.encode() if what in ("role", "text") else b"\n")
        raw = formatted.encode() if starts else b""
        for a, b in zip(starts, ends, strict=True):
            text = chat.unescape(raw[a:b].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(batches):
    """Keeps the order of format_chat's rows: nothing is shuffled between."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now = digest = None
    for b in batches:
        done = []
        for conv, part, formatted, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_start", "loss_end")), strict=True):
            if part == 0:
                if digest:
                    done.append((now, *digest.row()))
                now, digest = conv, Digest()
            digest.add(formatted, starts, ends)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((now, *digest.row()), types, strict=True)], names=names)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return chat.format_chat(turns.union(planted)).mapInArrow(read_back, SCHEMA)
