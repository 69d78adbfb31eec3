"""Tables from files and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The driver's tables.
TABLES = "region nation customer supplier part orders lineitem events".split()


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A file or folder of Parquet, CSV, JSON or ORC, by ``kind`` or the path's ending."""
    kind = kind or next((k for k in ("parquet", "csv", "json", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")
    if kind == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(kind).options(**options).load(path)


def write(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = frame.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    """In-memory rows; a thunk is called when the table is made."""
    return spark.createDataFrame(data() if callable(data) else data, schema)
