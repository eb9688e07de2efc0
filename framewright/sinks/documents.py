"""CSV and JSON sinks of manifests, reports and COCO instances."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.constants import CURATION_HEADER


def write_curation_csv(rows: DataFrame, path: str) -> None:
    """Curation manifest: header, quotes only where needed and doubled, null as empty."""
    rows.select(*CURATION_HEADER).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "nullValue", "").option("emptyValue", "").csv(path)


def write_decisions(images: DataFrame, path: str) -> None:
    """Accepted and rejected images as partitions; sources are left where they are."""
    images.write.mode("overwrite").partitionBy("decision").parquet(path)


def write_json(documents: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON document per line and row; ``compression`` as Spark names it."""
    documents.write.mode("overwrite").json(path, compression=compression)


def json_rows(documents: DataFrame, name: str = "document") -> DataFrame:
    return documents.select(F.to_json(F.struct(*documents.columns)).alias(name))


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def coco_lines(tables: dict[str, DataFrame], info: dict[str, str]) -> DataFrame:
    """Lines of one COCO document; sorted by (section, id) they form valid JSON.

    The document is never one row: each record is a line, led by a comma except
    the first of its section, so any number of annotations can be written.
    """
    spark = tables["images"].sparkSession
    head = json.dumps(info, sort_keys=True)
    fixed = [
        (0, 0, '{"info": ' + head + ', "licenses": []'), (1, 0, ', "images": ['),
        (3, 0, '], "annotations": ['), (5, 0, '], "categories": ['), (7, 0, "]}"),
    ]
    lines = spark.createDataFrame(fixed, "section int, id long, line string")
    for section, name in ((2, "images"), (4, "annotations"), (6, "categories")):
        t = tables[name]
        text = F.concat(F.when(F.col("id") > 1, ",").otherwise(""), F.to_json(F.struct(*t.columns)))
        lines = lines.unionByName(t.select(F.lit(section).alias("section"), F.col("id").cast("long"), text.alias("line")))
    return lines


def write_coco(tables: dict[str, DataFrame], info: dict[str, str], path: str) -> None:
    """Part files that, read in name order, are one COCO document."""
    coco_lines(tables, info).orderBy("section", "id").select("line").write.mode("overwrite").text(path)


def write_coco_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
