"""Object listings, image indexes, sync plans and upload plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.constants import DICOM_MAGIC, DICOM_MIN_BYTES
from framewright.functions import text as X
from framewright.plans.skew import MAX_KEY_ROWS, salted_join


def image_listing(files: DataFrame, path: str = "path", sink: str | None = None) -> DataFrame:
    """Image files by suffix in name order; files below the sink folder are left out."""
    out = files.where(X.has_extension(path))
    if sink:
        root = sink.rstrip("/")
        out = out.where((F.col(path) != root) & ~F.col(path).startswith(root + "/"))
    return out.withColumn("name", X.file_name(path)).orderBy(*X.ignoring_case("name"), path)


def image_index(objects: DataFrame, scope: str, bucket: str = "") -> DataFrame:
    """Image keys under a scope, ordered ignoring case."""
    prefix = X.scope_prefix(scope, bucket)
    scoped = objects.where(F.col("key").startswith(prefix)) if prefix else objects
    return scoped.where(X.has_extension("key")).orderBy(*X.ignoring_case("key"))


def head_of(index: DataFrame, n: int) -> DataFrame:
    """First n keys in order: a top-n per task, then one merge."""
    return index.orderBy(*X.ignoring_case("key")).limit(n)


def sync_plan(
    remote: DataFrame, local: DataFrame, max_key_rows: int = MAX_KEY_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Action per remote key: ``skip`` what the mirror holds, ``download`` the rest.

    An empty remote object cannot be mirrored and is ``failed`` unless present.
    """
    mirror = local.groupBy("key").agg(F.max("size").alias("local_size"))
    joined = salted_join(remote, mirror, ["key"], "left", max_key_rows=max_key_rows, at_most=at_most)
    return joined.withColumn(
        "action",
        F.when(F.coalesce("local_size", F.lit(0)) > 0, "skip").when(F.col("size") > 0, "download").otherwise("failed"))


def sync_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "download").alias("downloaded"),
        F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") == "failed").alias("failed"))


def pending(manifests: DataFrame, finished: DataFrame, on: str = "path", force: bool = False) -> DataFrame:
    """Manifests without a done marker, or all of them when forced."""
    return manifests if force else manifests.join(finished.select(on), on, "left_anti")


def add_unique(files: DataFrame, more: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Union that ignores files already listed; repeats are merged before the shuffle."""
    return files.unionByName(more).dropDuplicates(list(on))


def upload_plan(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """Object key of every local file: prefix + path below the root."""
    base = root.rstrip("/") + "/"
    key = F.concat(F.lit(prefix), F.substr("path", F.lit(len(base) + 1)))
    return files.where(F.col("path").startswith(base)).withColumn("key", key)


def dicom_screen(heads: DataFrame, skip_validation: bool = False) -> DataFrame:
    """Verdict per ``.dcm`` file from its length and first bytes (``head``)."""
    named = heads.where(X.has_extension("path", ("dcm",)))
    if skip_validation:
        return named.withColumn("verdict", F.lit("ok"))
    magic = F.substring(F.col("head"), 129, 4)
    return named.withColumn(
        "verdict",
        F.when(F.col("length") < DICOM_MIN_BYTES, "file too small")
        .when(magic == F.lit(DICOM_MAGIC).cast("binary"), "ok").otherwise("not a valid DICOM file"))


def dicom_totals(screened: DataFrame, *by: str) -> DataFrame:
    ok = F.count_if(F.col("verdict") == "ok")
    return screened.groupBy(*by).agg(
        F.count(F.lit(1)).alias("found"), ok.alias("ok"), (F.count(F.lit(1)) - ok).alias("skipped"))


def with_ordinal_name(prefix: str, ordinal) -> Column:
    return F.concat(F.lit(prefix), F.col(ordinal).cast("string"))
