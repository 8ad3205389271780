"""Tables kept in memory or as Parquet folders, written in rows, columns or frames and read by column and predicate.

A reader gives DataFrames, so filters and column choices reach the Parquet scan; arrays come batch by batch and hold
``batch_size`` rows at most. A folder has its Parquet files and a ``config.json`` with schema and options.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPTIONS = ("schema", "batch_size", "rows_per_file", "compression")


def as_schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def encode_schema(schema: StructType) -> str:
    return schema.json()


def decode_schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def chosen(frame: DataFrame, columns: Sequence[str] | None = None, filter: Column | str | None = None) -> DataFrame:
    """The filter sees all columns, also those that aren't chosen."""
    kept = frame if filter is None else frame.where(filter)
    return kept if columns is None else kept.select(*columns)


def batches(frame: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``; the driver holds a partition at a time."""
    rows = frame.toLocalIterator(prefetchPartitions=False)
    while part := list(islice(rows, size)):
        yield part


class Reader:
    """Scans of one table."""

    def __init__(self, frame: DataFrame, batch_size: int = 10_000):
        self.frame, self.batch_size = frame, batch_size

    @property
    def schema(self) -> StructType:
        return self.frame.schema

    def count_rows(self) -> int:
        return self.frame.count()

    def count_tables(self) -> int:
        return 1

    def iterate_tables(self, columns: Sequence[str] | None = None, filter: Column | str | None = None) -> Iterator[DataFrame]:
        yield chosen(self.frame, columns, filter)

    def iterate_arrays(self, numeric_columns: Sequence[str], filter: Column | str | None = None) -> Iterator[np.ndarray]:
        for rows in batches(chosen(self.frame, numeric_columns, filter), self.batch_size):
            yield np.array([tuple(r) for r in rows], np.float64)

    def iterate_tables_with_arrays(self, columns: Sequence[str], numeric_columns: Sequence[str], filter: Column | str | None = None) -> Iterator[tuple[list[dict], np.ndarray]]:
        """Rows as dicts of ``columns`` with a matrix of ``numeric_columns``; each column is read once."""
        both = list(dict.fromkeys([*columns, *numeric_columns]))
        for rows in batches(chosen(self.frame, both, filter), self.batch_size):
            yield [{c: r[c] for c in columns} for r in rows], np.array([[r[c] for c in numeric_columns] for r in rows], np.float64)

    def iterate_fragment_batch_iterators(self, batch_size: int | None = None) -> Iterator[Iterator[list]]:
        for fragment in self._fragments():
            yield batches(fragment, batch_size or self.batch_size)

    def _fragments(self) -> Iterator[DataFrame]:
        yield self.frame


class Writer:
    """Rows and columns are buffered up to ``batch_size``; frames are taken as they are. Leaving its block flushes."""

    def __init__(self, spark: SparkSession, schema: StructType | str, batch_size: int = 10_000):
        self.spark, self.schema, self.batch_size = spark, as_schema(schema), batch_size
        self.rows: list[dict] = []

    def write_rows(self, rows: Iterable[dict]) -> None:
        """Keys that the schema lacks are dropped, missing ones are null."""
        names = self.schema.fieldNames()
        for row in rows:
            self.rows.append({n: row.get(n) for n in names})
            if len(self.rows) >= self.batch_size:
                self.flush()

    def write_columns(self, columns: dict[str, Sequence]) -> None:
        self.write_rows([dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)])

    def write_table(self, frame: DataFrame) -> None:
        self.flush()
        self._append(frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)))

    write_batch = write_table

    def flush(self) -> None:
        if self.rows:
            rows, self.rows = self.rows, []
            self._append(self.spark.createDataFrame([tuple(r.values()) for r in rows], self.schema))

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()


class MemoryWriter(Writer):
    def __init__(self, spark: SparkSession, schema: StructType | str, batch_size: int = 10_000):
        super().__init__(spark, schema, batch_size)
        self.parts: list[DataFrame] = []

    create = classmethod(lambda cls, spark, schema, batch_size=10_000: cls(spark, schema, batch_size))

    def _append(self, frame: DataFrame) -> None:
        self.parts.append(frame)

    def _all(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for part in self.parts:
            out = out.union(part)
        return out

    def sort_by(self, *by: str | Column) -> None:
        self.flush()
        self.parts = [self._all().orderBy(*by)]

    def to_reader(self) -> Reader:
        self.flush()
        return Reader(self._all(), self.batch_size)


class FileReader(Reader):
    """A written folder."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, batch_size: int, rows_per_file: int, compression: str):
        super().__init__(spark.read.schema(schema).parquet(f"{path}/rows"), batch_size)
        self.spark, self.path, self.rows_per_file, self.compression = spark, path, rows_per_file, compression

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FileReader:
        """FileNotFoundError without the path, NotADirectoryError for a file, KeyError for an option that is missing or empty."""
        fs, at = _fs(spark, path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        if not fs.getFileStatus(at).isDirectory():
            raise NotADirectoryError(path)
        config = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/config.json").collect()))
        for name in OPTIONS:
            if not config.get(name):
                raise KeyError(name)
        return cls(spark, path, decode_schema(config["schema"]), *(config[n] for n in OPTIONS[1:]))

    def get_files(self) -> list[str]:
        """Parquet files, by name."""
        fs, at = _fs(self.spark, f"{self.path}/rows")
        if not fs.exists(at):
            return []
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet"))

    def count_tables(self) -> int:
        return len(self.get_files())

    def _fragments(self) -> Iterator[DataFrame]:
        for file in self.get_files():
            yield self.spark.read.schema(self.schema).parquet(file)

    def iterate_ordered_fragments(self, filter: Column | str | None = None) -> Iterator[str]:
        """Files with rows that pass, by name; one scan finds them."""
        name = F.col("_metadata.file_name")
        kept = self.frame if filter is None else self.frame.where(filter)
        found = {r[0] for r in kept.select(name.alias("f")).distinct().collect()}
        yield from (f for f in self.get_files() if f.rsplit("/", 1)[-1] in found)


class FileWriter(Writer):
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, batch_size: int = 10_000, rows_per_file: int = 100_000, compression: str = "snappy"):
        super().__init__(spark, schema, batch_size)
        self.path, self.rows_per_file, self.compression = path, rows_per_file, compression

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, batch_size: int = 10_000, rows_per_file: int = 100_000, compression: str = "snappy", delete_if_exists: bool = False) -> FileWriter:
        fs, at = _fs(spark, path)
        if fs.exists(at):
            if not delete_if_exists:
                raise FileExistsError(path)
            cls.delete(spark, path)
        out = cls(spark, path, schema, batch_size, rows_per_file, compression)
        fs.mkdirs(at)
        config = {"schema": encode_schema(out.schema), "batch_size": batch_size, "rows_per_file": rows_per_file, "compression": compression}
        stream = fs.create(_fs(spark, f"{path}/config.json")[1], True)
        stream.write(bytearray(json.dumps(config).encode()))
        stream.close()
        out._append(spark.createDataFrame([], out.schema))
        return out

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        """A missing path is no error."""
        fs, at = _fs(spark, path)
        fs.delete(at, True)

    def _save(self, frame: DataFrame, path: str) -> None:
        frame.write.mode("append").option("compression", self.compression).option("maxRecordsPerFile", self.rows_per_file).parquet(path)

    def _append(self, frame: DataFrame) -> None:
        self._save(frame, f"{self.path}/rows")

    def sort_by(self, *by: str | Column) -> None:
        """Sort each file on its own: rows of a file meet in one task and stay together."""
        self.flush()
        fs, rows = _fs(self.spark, f"{self.path}/rows")
        _, new = _fs(self.spark, f"{self.path}/sorted")
        old = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        named = old.select("*", F.col("_metadata.file_name").alias("_file"))
        self._save(named.repartition("_file").sortWithinPartitions("_file", *by).drop("_file"), f"{self.path}/sorted")
        fs.delete(rows, True)
        fs.rename(new, rows)

    def to_reader(self) -> FileReader:
        self.flush()
        return FileReader.load(self.spark, self.path)


def global_sort(frame: DataFrame, by: Sequence[str | Column], columns: Sequence[str] | None = None, table_sort_override: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One order over all rows: Spark's range exchange and a spilling merge in each range. ``table_sort_override`` gets the rows
    dealt by ranges and orders them within these in a way of its own."""
    if table_sort_override is None:
        return chosen(frame.orderBy(*by), columns)
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chosen(table_sort_override(frame.repartitionByRange(tasks, *by)), columns)


def read_json_pairs(spark: SparkSession, truths: str, predictions: str, key: str = "uid") -> DataFrame:
    """Two files of JSON lines joined by the datum's key; columns of either side get its prefix."""
    left, right = (spark.read.json(p) for p in (truths, predictions))
    left = left.select(key, *(F.col(c).alias(f"gt_{c}") for c in left.columns if c != key))
    right = right.select(key, *(F.col(c).alias(f"pd_{c}") for c in right.columns if c != key))
    return left.join(right, key, "full")
