"""Media columns: archives of lossless media, and a data source that reads them by byte range.

`store` turns payloads into 8-bit grey PNG images of 576 samples a row and writes them to zip archives in the shared
folder. The data source `lamella_archives` plans partitions of (archive, byte range) from the archives' sizes alone; a
reader takes the members whose headers begin in its range, reads each by its offset, checks its CRC and retries it by
itself with a freshly opened file. A member that fails every time becomes a row with an error; the others are not
affected. Payloads stream as Arrow batches of bounded size.

Archives of lost or repeated tasks are not in the manifest, a table that Spark commits, and are not read.

Results: a null text is an empty payload, and an empty one is one row of padding. Equal texts give equal media. A null id
is stored as none and comes back as null; rows that repeat, or share an id, are members of their own. A very long text is
one member, held as a whole while it is written and read. Columns other than id and text are not read. An empty table makes
no archive and gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamella.llm import common

SAMPLES = 576
#: A range reads its archive's directory once; archives that `store` writes are one range each.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 128 << 20, 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """UTF-8 never holds byte 255, so the padding can be told from the text."""
    return raw + b"\xff" * (-len(raw) % SAMPLES or (0 if raw else SAMPLES))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    lines = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, shape = 8, [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit mean hash: which of 64 equal stretches lie above the mean."""
    x = np.frombuffer(payload, np.uint8)
    cells = x.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(cells * 64 > cells.sum()).tobytes().hex()
    return f"m{x.mean():.3f}_d{x.std():.3f}_{bits}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes every text to an archive. Returns the manifest's path; its columns: archive, bytes, members. Narrow: no shuffle."""
    from pyarrow import fs

    folder = common.scratch(docs.sparkSession, "archives")

    def run(batches):
        done, at, out = [], None, None

        def close():
            nonlocal at
            at.close()
            done.append((name, out.tell(), members))
            out.close()
            at = None

        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1)), strict=True):
                if at is None:
                    name, members = f"{folder}/{uuid.uuid4().hex}.zip", 0
                    files, where = fs.FileSystem.from_uri(name)
                    out = files.open_output_stream(where)
                    at = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED)
                at.writestr(zipfile.ZipInfo(f"{members:07d}_{'' if k is None else k}.png"), encode_png(pad(raw)))
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        if at is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "bytes": pa.array([x[1] for x in done], pa.int64()), "members": pa.array([x[2] for x in done], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "archive string, bytes long, members long")
    return common.write_table(rows, "archives-manifest")


class _Stream:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


@dataclass
class ByteRange(InputPartition):
    archive: str
    first: int
    end: int


def open_archive(uri: str):
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(uri)
    return files.open_input_file(where)


def read_member(uri: str, info: zipfile.ZipInfo, source=None) -> bytes:
    """A stored or deflated member by its offset."""
    own = source is None
    source = source or open_archive(uri)
    try:
        source.seek(info.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack_from("<HH", head, 26)
        source.seek(info.header_offset + 30 + name + extra)
        raw = source.read(info.compress_size)
        raw = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
        if zlib.crc32(raw) != info.CRC:
            raise ValueError("CRC differs")
        return raw
    finally:
        if own:
            source.close()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.manifest = options.get("path"), options.get("manifest")
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", 3))

    def archives(self) -> list[tuple[str, int]]:
        """The manifest's archives, or the folder's. The driver holds one entry for each archive, not for its members."""
        from pyarrow import dataset, fs

        if self.manifest:
            files, where = fs.FileSystem.from_uri(self.manifest)
            rows = dataset.dataset(where, filesystem=files, format="parquet").to_table(columns=["archive", "bytes"]).to_pylist()
            return sorted((r["archive"], r["bytes"]) for r in rows)
        files, where = fs.FileSystem.from_uri(self.folder)
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        return sorted((scheme + x.path, x.size) for x in files.get_file_info(fs.FileSelector(where, recursive=True)) if x.is_file and x.path.endswith(".zip"))

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(a, k, min(k + self.range, n)) for a, n in self.archives() for k in range(0, n, self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.archive:
            return
        names, ats, payloads, errors, held = [], [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([partition.archive] * len(names)), pa.array(names, pa.string()), pa.array(ats, pa.int64()), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], names=["archive", "member", "at", "payload", "error"])

        with open_archive(partition.archive) as source:
            for info in zipfile.ZipFile(source).infolist():
                if not partition.first <= info.header_offset < partition.end:
                    continue
                raw = error = None
                for attempt in range(self.tries):
                    try:
                        raw, error = read_member(partition.archive, info, None if attempt else source), None
                        break
                    except (OSError, ValueError, zlib.error) as e:
                        error = str(e)
                names.append(info.filename)
                ats.append(info.header_offset)
                payloads.append(raw)
                errors.append(error)
                held += len(raw or b"")
                if held >= BATCH_BYTES or len(names) >= 4000:
                    yield batch()
                    names, ats, payloads, errors, held = [], [], [], [], 0
        if names:
            yield batch()


class ArchiveSource(DataSource):
    """spark.read.format("lamella_archives").load(folder); options manifest, rangeBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "lamella_archives"

    def schema(self) -> str:
        return "archive string, member string, at long, payload binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def load(spark: SparkSession, folder: str | None = None, manifest: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("lamella_archives").options(**options)
    return (reader.option("manifest", manifest) if manifest else reader.option("path", folder)).load()
