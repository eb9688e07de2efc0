"""NIfTI-1 headers and slices by ranged reads."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.constants import VOLUME_EXTENSIONS, VOXEL_TYPES
from framewright.functions import text as X
from framewright.schemas import VOLUME_HEADER
from framewright.sources.files import list_files, open_location, read_heads

HEADER_BYTES = 348
_NUMPY_TYPE = {code: kind for code, _, kind in VOXEL_TYPES}
_TYPE_NAME = {code: name for code, name, _ in VOXEL_TYPES}


def header_dtype(order: str) -> np.dtype:
    """Fields of the 348-byte header that are read, at their byte offsets."""
    return np.dtype({
        "names": ["size", "dim", "datatype", "bitpix", "pixdim", "vox_offset"],
        "formats": [f"{order}i4", f"({8},){order}i2", f"{order}i2", f"{order}i2", f"({8},){order}f4", f"{order}f4"],
        "offsets": [0, 40, 70, 72, 76, 108], "itemsize": HEADER_BYTES,
    })


def parse_header(head: bytes | None) -> dict:
    """Header values with repaired dimensions, spacings and data offset."""
    if head is None or len(head) < HEADER_BYTES:
        return {"reject": "unexpected end of file"}
    for order in "<>":
        raw = np.frombuffer(head, header_dtype(order), 1)[0]
        if raw["size"] == HEADER_BYTES:
            break
    else:
        return {"reject": "invalid header size"}
    dim = raw["dim"].astype(int)
    n = int(dim[0]) if 1 <= dim[0] <= 7 else 3
    dim[0] = n
    dim[1:n + 1] = np.maximum(dim[1:n + 1], 1)
    dim[n + 1:] = 1
    pixdim = raw["pixdim"].astype(np.float32)
    if not 0 <= pixdim[0] <= 7:
        pixdim[0] = n
    used = np.arange(8) <= n
    sound = np.isfinite(pixdim) & (pixdim > 0) & (pixdim <= 1000)
    pixdim[1:] = np.where((used & sound)[1:], pixdim[1:], 1.0)
    offset = float(raw["vox_offset"])
    code = int(raw["datatype"])
    return {
        "big_endian": order == ">", "dim": dim.tolist(), "datatype": code, "bitpix": int(raw["bitpix"]),
        "vox_offset": int(offset) if 0 < offset <= 1e9 else 352, "pixdim": pixdim.tolist(),
        "reject": None if _NUMPY_TYPE.get(code) else f"unsupported type {_TYPE_NAME.get(code, code)}",
    }


@F.pandas_udf(VOLUME_HEADER)
def decode_header(head: pd.Series) -> pd.DataFrame:
    rows = [parse_header(h) for h in head]
    return pd.DataFrame([[r.get(f) for f in VOLUME_HEADER.names] for r in rows], columns=VOLUME_HEADER.names).astype(object)


def list_volumes(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root).where(X.has_extension("path", VOLUME_EXTENSIONS))


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """Header catalogue of the volumes below a folder; ``reject`` says what cannot be read."""
    heads = read_heads(list_volumes(spark, root), HEADER_BYTES)
    return heads.withColumn("_h", decode_header("head")).select("path", "length", "_h.*")


def without_cut_short(headers: DataFrame) -> DataFrame:
    """Headers whose files hold fewer voxels than they promise get a ``reject`` reason.

    A plain file is judged by its length; a packed one is unpacked once, by one task, and
    thrown away as it goes.
    """
    itemsize = F.create_map(*[F.lit(v) for code, kind in _NUMPY_TYPE.items() if kind for v in (code, np.dtype(kind).itemsize)])
    w, h, d = (F.greatest(F.lit(1), F.col("dim")[k].cast("long")) for k in (1, 2, 3))
    need = F.col("vox_offset").cast("long") + w * h * d * itemsize[F.col("datatype").cast("int")]
    named = headers.withColumn("_need", F.when(F.col("reject").isNull(), need))
    schema = T.StructType([*named.schema.fields, T.StructField("_held", T.LongType())])

    def unpacked(path: str, most: int) -> int:
        held = 0
        try:
            fs, name = open_location(path)
            with gzip.open(fs.open_input_stream(name, compression=None)) as f:
                while held < most and (data := f.read(1 << 20)):
                    held += len(data)
        except (OSError, EOFError, zlib.error):
            pass
        return held

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "length", "_need")))
            values = [None if n is None else unpacked(p, n) if p.lower().endswith(".gz") else size for p, size, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], [*batch.schema.names, "_held"])

    return named.mapInArrow(held, schema).withColumn("reject", F.when(
        F.col("_held") < F.col("_need"), "volume cut short").otherwise(F.col("reject"))).drop("_need", "_held")


def read_slices(headers: DataFrame, slices_per_task: int = 64) -> DataFrame:
    """Axial slices of readable volumes, one row each; a volume cut short is an error, see
    :func:`without_cut_short`.

    A plain volume is read by byte ranges, so its slices spread over tasks; a
    packed one can only be streamed, by one task, holding one slice at a time.
    """
    ready = headers.where(F.col("reject").isNull())
    depth = F.greatest(F.lit(1), F.col("dim")[3].cast("int"))
    packed = F.lower("path").endswith(".gz")
    step = F.when(packed, depth).otherwise(F.lit(slices_per_task))
    spans = ready.select(
        "path", "big_endian", "dim", "datatype", "vox_offset", depth.alias("depth"), step.alias("step"),
        F.explode(F.sequence(F.lit(0), depth - 1, step)).alias("first"))
    spans = spans.repartition("path", "first")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype((">" if r["big_endian"] else "<") + _NUMPY_TYPE[r["datatype"]])
                w, h = r["dim"][1], max(1, r["dim"][2])
                size = w * h * kind.itemsize
                fs, name = open_location(r["path"])
                gz = r["path"].lower().endswith(".gz")
                with (gzip.open(fs.open_input_stream(name, compression=None)) if gz else fs.open_input_file(name)) as f:
                    f.seek(r["vox_offset"] + r["first"] * size)
                    for z in range(r["first"], min(r["depth"], r["first"] + r["step"])):
                        data = f.read(size)
                        if len(data) < size:
                            raise EOFError(f"{r['path']}: slice {z} of {r['depth']} is cut short")
                        vox = np.frombuffer(data, kind).astype(np.float64)
                        yield pa.RecordBatch.from_pydict({
                            "volume_id": [r["path"]], "z": pa.array([z], pa.int32()), "width": pa.array([w], pa.int32()),
                            "height": pa.array([h], pa.int32()), "vox": pa.array([vox], pa.list_(pa.float64()))})

    return spans.mapInArrow(slices, "volume_id string, z int, width int, height int, vox array<double>")
