"""DICOM screening by name, length and the four magic bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.constants import DICOM_MIN_BYTES
from framewright.functions import text as X
from framewright.operators.catalog import dicom_screen
from framewright.sources.files import list_files, read_heads


def screen_files(spark: SparkSession, root: str, recursive: bool = True, skip_validation: bool = False) -> DataFrame:
    """Verdict of every ``.dcm`` file below a folder, reading 132 bytes of each."""
    files = list_files(spark, root, recursive).where(X.has_extension("path", ("dcm",)))
    if skip_validation:
        return dicom_screen(files, True)
    return dicom_screen(read_heads(files, DICOM_MIN_BYTES)).drop("head")


def output_path(path, source: str, output: str, preserve: bool):
    """PNG path of a file; ``preserve`` keeps its folders below the source."""
    root = source.rstrip("/") + "/"
    relative = F.substr(path, F.lit(len(root) + 1))
    kept = relative if preserve else X.file_name(path)
    return F.concat(F.lit(output.rstrip("/") + "/"), F.regexp_replace(kept, r"(?i)\.dcm$", ".png"))
