"""PNG bytes of pixel rows and their files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.kernel import kernel
from framewright.sources.files import open_location

_COLOUR_TYPE = {1: 0, 3: 2, 4: 6}


def png_bytes(px: bytes, height: int, width: int, channels: int) -> bytes:
    """PNG file of blue-green-red[-alpha] or gray samples."""
    image = np.frombuffer(px, np.uint8).reshape(height, width, channels)
    if channels >= 3:
        image = image[..., [2, 1, 0, 3][:channels]]
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = image.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, _COLOUR_TYPE[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


@kernel(T.BinaryType())
def encode_png(px: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    rows = zip(px, h.to_pylist(), w.to_pylist(), c.to_pylist())
    return pa.array([png_bytes(p.as_py(), *d) if p.is_valid else None for p, *d in rows], pa.binary())


def write_files(encoded: DataFrame) -> DataFrame:
    """Write ``data`` to ``target`` per row, temporary name first; returns target and size.

    A retried task writes the same bytes to the same name, so losing an executor
    leaves whole files only.  Run an action on the result to write.
    """
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            targets = batch.column("target").to_pylist()
            sizes = []
            for target, data in zip(targets, batch.column("data")):
                fs, name = open_location(target)
                folder, _, leaf = name.rpartition("/")
                if (at := target.rpartition("/")[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(at)
                part = f"{folder}/._{uuid.uuid4().hex}_{leaf}.part"
                with fs.open_output_stream(part) as out:
                    out.write(data.as_py())
                fs.move(part, name)
                sizes.append(len(data.as_py()))
            yield pa.RecordBatch.from_pydict({"target": pa.array(targets), "bytes": pa.array(sizes, pa.int64())})

    return encoded.select("target", "data").where(F.col("data").isNotNull()).mapInArrow(save, "target string, bytes bigint")


def write_png(images: DataFrame, target) -> DataFrame:
    """Encode pixel rows and write them to the path of column ``target``."""
    data = encode_png("px", "height", "width", "n_channels")
    return write_files(images.select(target.alias("target"), data.alias("data")))
