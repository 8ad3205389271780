"""A pair table as a Parquet folder with its metadata fields in a sidecar."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _table(path: str) -> str:
    return f"gaugeworks_{hashlib.md5(path.encode()).hexdigest()}"


def write(rows: DataFrame, path: str, metadata_fields: dict[str, str] | None = None, rows_per_file: int = 100_000, compression: str = "snappy", delete_if_exists: bool = False, bucket: str | None = None) -> None:
    """``bucket``: rows are dealt to as many buckets as the session has shuffle partitions by this column, and sorted by it."""
    spark, mode = rows.sparkSession, "overwrite" if delete_if_exists else "errorifexists"
    if mode == "errorifexists" and _exists(spark, f"{path}/rows"):
        raise FileExistsError(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if bucket else 0
    out = rows.repartition(buckets, bucket) if bucket else rows
    out = out.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", rows_per_file)
    if bucket:
        spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
        out.format("parquet").option("path", f"{path}/rows").bucketBy(buckets, bucket).sortBy(bucket).saveAsTable(_table(path))
    else:
        out.parquet(f"{path}/rows")
    side = json.dumps({"metadata_fields": metadata_fields or {}, "schema": rows.schema.jsonValue(), "bucket": bucket, "buckets": buckets})
    spark.createDataFrame([(side,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/sidecar")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows and the metadata fields. FileNotFoundError without the folder, KeyError without the sidecar.

    A bucketed folder is read as a table of the session's catalog, so what groups or joins by its bucket column needs no exchange.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if not _exists(spark, f"{path}/sidecar"):
        raise KeyError("sidecar")
    side = json.loads(spark.read.text(f"{path}/sidecar").first()[0])
    if not side.get("bucket"):
        return spark.read.parquet(f"{path}/rows"), side["metadata_fields"]
    columns = StructType.fromJson(side["schema"]).toDDL()
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")  # of an external table: its files stay
    spark.sql(f"CREATE TABLE {_table(path)} ({columns}) USING parquet CLUSTERED BY (`{side['bucket']}`) SORTED BY (`{side['bucket']}`) INTO {side['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(_table(path)), side["metadata_fields"]


def delete(spark: SparkSession, path: str) -> None:
    """A missing path is no error."""
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
