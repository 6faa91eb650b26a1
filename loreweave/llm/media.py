"""Media columns: payloads stored as progressive JPEG and read back as coefficients and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media``: each whole text as the coefficients of a progressive JPEG.

    Null counts as empty; the bytes are filled up with 255 to a positive
    multiple of 576. Equal texts give equal files. Nothing is shuffled.
    """

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([jpeg.encode(jpeg.pad((t.as_py() or "").encode())) for t in texts], pa.binary())

    return docs.withColumn("media", encode(F.col(text)))


def tensors(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``height``, ``width`` and ``rgb`` (row by row, 8-bit samples, 3 to a pixel); a null medium gives nulls."""

    @F.arrow_udf("struct<height: int, width: int, rgb: binary>")
    def decode(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            t = jpeg.decode(f.as_py()).rgb() if f.is_valid else None
            rows.append(None if t is None else {"height": t.shape[0], "width": t.shape[1], "rgb": t.tobytes()})
        return pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))

    return df.withColumn("__t", decode(F.col(media))).withColumns({c: F.col(f"__t.{c}") for c in ("height", "width", "rgb")}).drop("__t")


def digests(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds digests of the stored form and of the payload read back from it, and the features of the RGB tensor.

    Columns of ``df`` with the names of the result are replaced; a null medium gives nulls.
    """

    @F.arrow_udf("struct<payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, feature: string>")
    def digest(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            if not f.is_valid:
                rows.append((None,) * 6)
                continue
            raw = f.as_py()
            image = jpeg.decode(raw)
            back = jpeg.payload(image)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), jpeg.feature(image)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    done = df.withColumn("__d", digest(F.col(media)))
    return done.withColumns({c: F.col(f"__d.{c}") for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}).drop("__d")
