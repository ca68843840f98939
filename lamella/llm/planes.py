"""Token ids in binary files of compressed planes.

A file holds the ids of whole documents in ascending doc_id order:

    magic | chunk 0 | chunk 1 | ... | footer (zstandard) | footer offset, footer length (u64) | magic

A chunk is a block of BLOCK ids (the last may be shorter), transposed: plane k holds byte k (or bit k) of every id, and
each plane is compressed by itself, so that planes which are nearly constant cost nothing. The footer holds the chunk
index (offset and plane sizes) and each document's id and length. A reader needs one chunk in memory at a time.

Executors write files under names of their own; a file counts only if the manifest, a table that Spark commits, names it.
A repeated or lost task therefore leaves at most a file that nobody reads.

Order of equal doc_ids: by text; a null doc_id comes first. Null and empty texts hold the end id alone. Rows that repeat
are documents of their own. All rows of one doc_id lie in one file. A very long text is encoded as a whole in its task and
written in blocks. Columns other than id and text are not read. An empty table makes no file and gives no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import common

MAGIC = b"LAMPLAN1"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    flat = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(flat[:, k]), bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        cells = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            cells[:, k] = np.frombuffer(p, np.uint8)
        return cells.reshape(-1).view("<u4")
    flat = np.empty((n, 32), np.uint8)
    for k, p in enumerate(planes):
        flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 1):
        import zstandard

        self.out, self.bits, self.block = out, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.rest = b""
        self.index: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_ids: list, id_bytes: list[bytes]) -> None:
        self.doc_ids += doc_ids
        self.lengths += [len(x) // 4 for x in id_bytes]
        held = self.rest + b"".join(id_bytes)
        step, a = 4 * self.block, 0
        while len(held) - a >= step:
            self._chunk(held[a : a + step])
            a += step
        self.rest = held[a:]

    def _chunk(self, raw: bytes) -> None:
        planes = [self.pack(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.bits)]
        self.out.write(b"".join(planes))
        self.index.append([self.at, len(raw) // 4, *map(len, planes)])
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.rest:
            self._chunk(self.rest)
        nulls = [k for k, x in enumerate(self.doc_ids) if x is None]
        head = json.dumps({"bits": self.bits, "chunks": len(self.index), "docs": len(self.doc_ids), "nulls": nulls}).encode()
        body = np.asarray(self.index, "<u8").tobytes() + np.asarray([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.asarray(self.lengths, "<u8").tobytes()
        footer = self.pack(struct.pack("<Q", len(head)) + head + body)
        self.out.write(footer + struct.pack("<QQ", self.at, len(footer)) + MAGIC)
        self.out.close()


def read_planes(source) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, start in this file, id bytes) for each document, in order. source: a random access file."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    source.seek(source.size() - 24)
    at, size, magic = struct.unpack("<QQ8s", source.read(24))
    if magic != MAGIC:
        raise ValueError("not a plane file, or cut short")
    source.seek(at)
    footer = unpack(source.read(size))
    (n,) = struct.unpack_from("<Q", footer)
    head = json.loads(footer[8 : 8 + n])
    width = 2 + (32 if head["bits"] else 4)
    body, chunks, docs = footer[8 + n :], head["chunks"], head["docs"]
    index = np.frombuffer(body, "<u8", chunks * width).reshape(chunks, width)
    doc_ids: list = np.frombuffer(body, "<i8", docs, 8 * chunks * width).tolist()
    lengths = np.frombuffer(body, "<u8", docs, 8 * (chunks * width + docs)).tolist()
    for k in head["nulls"]:
        doc_ids[k] = None

    def blocks() -> Iterator[bytes]:
        for row in index.tolist():
            source.seek(row[0])
            raw, cut, planes = source.read(sum(row[2:])), 0, []
            for s in row[2:]:
                planes.append(unpack(raw[cut : cut + s]))
                cut += s
            yield from_planes(planes, row[1], head["bits"]).tobytes()

    stream, held, pos, start = blocks(), b"", 0, 0
    for doc, length in zip(doc_ids, lengths, strict=True):
        parts, need = [], 4 * length
        while need:
            if pos == len(held):
                held, pos = next(stream), 0
            parts.append(held[pos : pos + need])
            pos += len(parts[-1])
            need -= len(parts[-1])
        yield doc, start, b"".join(parts)
        start += length


def write_ids(docs: DataFrame, path: str, end_id: int | None = None, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs and writes plane files in ascending id order to the shared folder. Returns the manifest: part, path, n_docs, n_ids."""
    from pyarrow import fs

    folder = common.scratch(docs.sparkSession, "planes")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        from lamella.llm.bpe import codec

        part = TaskContext.get().partitionId()
        writer, name, total = None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes", 0
        for b in common.lean(batches):
            if not b.num_rows:
                continue
            if writer is None:
                store, where = fs.FileSystem.from_uri(name)
                writer = PlaneWriter(store.open_output_stream(where), bits)
            ids = [x + end for x in codec(path).id_bytes(b.column(1))]
            total += sum(map(len, ids)) // 4
            writer.add(b.column(0).to_pylist(), ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_docs": pa.array([len(writer.lengths)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    return common.written(ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "planes-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary, little-endian unsigned 32-bit), from the files.

    The driver holds one row for each file, to add up the files' starts.
    """
    from pyarrow import fs

    spark = manifest.sparkSession
    files, base = [], 0
    for r in sorted(manifest.select("part", "path", "n_ids").collect()):
        files.append((r.path, base))
        base += r.n_ids

    def run(batches):
        for b in common.lean(batches):
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as source:
                    docs, starts, ids, held = [], [], [], 0
                    for doc, start, raw in read_planes(source):
                        docs.append(doc)
                        starts.append(base + start)
                        ids.append(raw)
                        held += len(raw)
                        if held > 4 << 20 or len(docs) >= 4000:
                            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
                            docs, starts, ids, held = [], [], [], 0
                    if docs:
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    plan = spark.createDataFrame(files, "path string, base long")
    return plan.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, ids binary")
