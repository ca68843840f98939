"""Chat formatting by columnar byte assembly.

A turn becomes `[INST]role[/INST]text</s>`, and a conversation begins with `<s>`. These four control strings are escaped
inside roles and texts: every backslash is doubled, then each control string gets a backslash after its first character.
As all other backslashes come in pairs, taking one away from each run restores the text exactly, and an escaped text
holds no control string.

For each Arrow batch numpy computes the lengths of all segments (headers, roles, texts, ends), their offsets in the output
and the source index of every output byte; one gather fills one preallocated Arrow buffer, over which the output strings
are cut. The loss mask is the byte spans of assistant texts.

A conversation is one row, unless it is longer than PART bytes; then it goes on in further rows. A role or text that is
longer than PART is cut as well, never within a character or a control string, so that a part may begin or end within a
text: what is held besides the input batch is a few times PART, for turns of any length. The parts of a conversation, one
after the other, are the formatted conversation; each part's escapes and spans stand by themselves. n_turns counts the
turns that begin in a part. Rows of a conversation come in order of part, in one partition: one task writes a conversation.

Results: null roles and texts are empty. Turns with the same number come in order of role, then text, and repeated rows
are repeated turns. A null turn comes first. Rows without a conv_id are one conversation. A conversation without assistant
turns has an empty loss mask. Other columns are not read, and an empty table has no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.words import plain_texts

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"(<s>|\[INST\]|\[/INST\]|</s>)")
TRAINED = "assistant"
PART = 4 << 20
SCHEMA = "conv_id long, part int, n_turns int, formatted string, loss_start array<int>, loss_end array<int>"


def escape(column: pa.Array) -> pa.Array:
    out = pc.replace_substring(plain_texts(column), "\\", "\\\\")
    for control in (BEGIN, OPEN, CLOSE, END):
        out = pc.replace_substring(out, control, f"{control[0]}\\{control[1:]}")
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string column, and the offsets into them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def assemble(t: pa.Table, first: np.ndarray, part_of: np.ndarray, part_no: np.ndarray) -> pa.RecordBatch:
    """One row for each part. t: pieces of turns; first: those that begin a conversation; part_of: each one's part, ascending; part_no: each part's number."""
    n = t.num_rows
    constants = np.frombuffer("".join((BEGIN, OPEN, CLOSE, END)).encode(), np.uint8)
    (role_data, role_at), (text_data, text_at) = (_bytes_of(escape(t[c].combine_chunks())) for c in ("role", "text"))
    opens, closes, ends_, trained = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("open", "close", "end", "trained"))
    source = np.concatenate([constants, role_data, text_data])
    lengths, starts = np.empty((n, 6), np.int64), np.empty((n, 6), np.int64)
    at = 0
    for column, text, has in ((0, BEGIN, first), (1, OPEN, opens), (3, CLOSE, closes), (5, END, ends_)):
        starts[:, column], lengths[:, column] = at, len(text) * has
        at += len(text)
    for column, offsets, base in ((2, role_at, at), (4, text_at, at + len(role_data))):
        starts[:, column], lengths[:, column] = base + offsets[:-1], np.diff(offsets)
    ends = np.cumsum(lengths.ravel())
    begins = ends - lengths.ravel()
    total = int(ends[-1])
    buffer = pa.allocate_buffer(total)
    kind = np.int32 if max(total, len(source)) < 1 << 31 else np.int64
    index = np.arange(total, dtype=kind)
    index += np.repeat((starts.ravel() - begins).astype(kind), lengths.ravel())
    np.take(source, index, out=np.frombuffer(buffer, np.uint8))
    del index
    head = np.flatnonzero(np.r_[True, part_of[1:] != part_of[:-1]])
    cut = np.r_[begins.reshape(n, 6)[head, 0], total]
    rank = np.searchsorted(head, np.arange(n), "right") - 1
    trained = trained & (lengths[:, 4] > 0)
    span_start = begins.reshape(n, 6)[trained, 4] - cut[rank[trained]]
    span_end = span_start + lengths[trained, 4]
    spans = pa.array(np.r_[0, np.cumsum(np.bincount(rank[trained], minlength=len(head)))], pa.int32())
    turns = np.add.reduceat(opens.astype(np.int32), head)
    return pa.RecordBatch.from_arrays(
        [t["conv_id"].combine_chunks().take(pa.array(head)), pa.array(part_no, pa.int32()), pa.array(turns, pa.int32()), pa.StringArray.from_buffers(len(head), pa.array(cut, pa.int32()).buffers()[1], buffer), pa.ListArray.from_arrays(spans, pa.array(span_start, pa.int32())), pa.ListArray.from_arrays(spans, pa.array(span_end, pa.int32()))],
        names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def _cuts(raw: np.ndarray, limit: int) -> list[int]:
    """Where UTF-8 bytes are cut in pieces of about `limit` at most: not within a character or a control string."""
    controls = [c.encode() for c in (BEGIN, OPEN, CLOSE, END)]

    def whole(k: int, step: int) -> int:
        while 0 < k < len(raw) and raw[k] & 0xC0 == 0x80:
            k += step
        low = max(0, k - 6)
        around = raw[low : k + 6].tobytes()
        for control in controls:
            i = around.find(control)
            while i >= 0:
                if low + i < k < low + i + len(control):
                    return low + i + (len(control) if step > 0 else 0)
                i = around.find(control, i + 1)
        return k

    out = [0]
    while len(raw) - out[-1] > limit:
        k = whole(out[-1] + limit, -1)
        k = k if k > out[-1] else whole(out[-1] + limit, 1)
        if k >= len(raw):
            break
        out.append(k)
    return [*out, len(raw)]


def _piece(conv: pa.Array, roles: pa.Array, texts: pa.Array, opens: bool = True, closes: bool = True, ends: bool = True, trained: pa.Array | None = None) -> pa.Table:
    n = len(roles)
    trained = pc.equal(roles, TRAINED) if trained is None else trained
    return pa.table([conv, roles, texts, *(pa.array(np.full(n, x)) for x in (opens, closes, ends)), trained], names=["conv_id", "role", "text", "open", "close", "end", "trained"])


def _part_of(column: pa.Array, row: int, a: int, b: int) -> pa.Array:
    """Bytes a to b of a string of a column, without a copy."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset + row]
    data = column.buffers()[2]
    return pa.Array.from_buffers(pa.large_string(), 1, [None, pa.array([0, b - a], pa.int64()).buffers()[1], data.slice(int(at) + a, b - a) if data is not None else None])


def _pieces(batch: pa.RecordBatch, limit: int):
    """The turns of a batch in tables of at most `limit` bytes; longer turns in several, cut in the role or the text."""
    conv = batch.column(0)
    roles, texts = (plain_texts(batch.column(k)) for k in (1, 2))
    sizes = sum(pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (roles, texts))
    a, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > a and held + size > limit:
            yield _piece(conv.slice(a, k - a), roles.slice(a, k - a), texts.slice(a, k - a))
            a, held = k, 0
        held += size
        if size <= limit:
            continue
        a, held = k + 1, 0
        cuts = [_cuts(_bytes_of(x.slice(k, 1))[0][slice(*_bytes_of(x.slice(k, 1))[1])], limit) for x in (roles, texts)]
        nothing, own = pa.array([""], pa.large_string()), pc.equal(roles.slice(k, 1), TRAINED)
        spans = [[(0, x, y) for x, y in zip(cuts[0], cuts[0][1:], strict=False)], [(1, x, y) for x, y in zip(cuts[1], cuts[1][1:], strict=False)]]
        for j, (which, x, y) in enumerate(flat := spans[0] + spans[1]):
            part = _part_of((roles, texts)[which], k, x, y)
            yield _piece(conv.slice(k, 1), nothing if which else part, part if which else nothing, j == 0, which == 1 and flat[j - 1][0] == 0, j == len(flat) - 1, own)
    if a < len(sizes):
        yield _piece(conv.slice(a), roles.slice(a), texts.slice(a))


def _format(batches, limit: int):
    """Batches of sorted turns to parts. The last conversation of a batch waits for the next one, unless it is long."""
    held: pa.Table | None = None
    last, number = (), 0  # the conversation that was written last without its end, and its next part

    def emit(t: pa.Table, complete: bool):
        nonlocal last, number
        ids = t["conv_id"].to_pylist()
        new = np.asarray([True, *(a != b for a, b in zip(ids[1:], ids, strict=False))])
        first = new.copy()
        goes_on = last == (ids[0],)
        first[0] = not goes_on
        size = np.cumsum(pc.add(pc.binary_length(t["text"]), pc.binary_length(t["role"])).to_numpy()).astype(np.int64)
        starts = np.flatnonzero(new)
        within = size - np.r_[0, size][starts][np.cumsum(new) - 1]
        cuts = new | (np.r_[-1, within[:-1] // limit] != within // limit)
        part_of = np.cumsum(cuts)
        heads = np.flatnonzero(cuts)
        conv_of = np.cumsum(new)[heads]
        part_no = np.arange(len(heads)) - np.flatnonzero(np.r_[True, conv_of[1:] != conv_of[:-1]])[conv_of - 1]
        if goes_on:
            part_no[conv_of == 1] += number
        last, number = ((), 0) if complete else ((ids[-1],), int(part_no[-1]) + 1)
        return assemble(t, first, part_of, part_no)

    for b in common.lean(batches):
        for piece in _pieces(b, limit) if b.num_rows else ():
            t = piece if held is None else pa.concat_tables([held, piece])
            ids = t["conv_id"].to_pylist()
            k = len(ids)
            while k and ids[k - 1] == ids[-1]:
                k -= 1
            if k:
                yield emit(t.slice(0, k), True)
            held = t.slice(k)
            if held.nbytes > limit:
                yield emit(held, False)
                held = None
    if held is not None:
        yield emit(held, True)


def format_chat(turns: DataFrame, limit: int = PART) -> DataFrame:
    """turns: conv_id, turn, role, text. See SCHEMA for the result."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(lambda it: _format(it, limit), SCHEMA)


class Reader:
    """Reads the parts of a conversation, in order, as pieces of roles and texts."""

    def __init__(self):
        self.inside = ""

    def read(self, formatted: str):
        """(what, text): "role" or "text" with a piece of it, unescaped; "turn" with nothing where a turn ends."""
        for k, piece in enumerate(CONTROL.split(formatted)):
            if k % 2:
                self.inside = {OPEN: "role", CLOSE: "text"}.get(piece, "")
                if piece == CLOSE:
                    yield "role ends", ""
                elif piece == END:
                    yield "turn", ""
            elif piece:
                yield self.inside, unescape(piece)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of whole turns."""
    out, now = [], {"role": "", "text": ""}
    for what, piece in Reader().read(formatted):
        if what == "turn":
            out.append((now["role"], now["text"]))
            now = {"role": "", "text": ""}
        elif what in now:
            now[what] += piece
    return out
