"""Query of operator 10: every text stored as an image in an archive, read back, and described."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lamella.llm import common, media

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(batches):
    for b in batches:
        rows: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
        for name, stored, error in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if error is not None:
                raise OSError(f"{name}: {error}")
            payload, own = media.decode_png(stored), name.rpartition("_")[2].removesuffix(".png")
            values = (int(own) if own else None, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
            for column, v in zip(rows.values(), values, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in rows.items()})


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    manifest = media.store(common.table(spark, sf_dir, "documents"))
    back = media.load(spark, manifest=manifest)
    return back.select("member", "payload", "error").mapInArrow(describe, SCHEMA)
