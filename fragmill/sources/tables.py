"""Reading tables with the columns an operator needs checked before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """df itself; ValueError names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One Parquet table of a folder; with columns, only these, checked."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns is None:
        return df
    columns = list(columns)
    return require(df, columns, name).select(*columns)


def read_csv(spark: SparkSession, path: str, schema, header: bool = True, run_column: str | None = None) -> DataFrame:
    """CSV with an explicit schema; quoted line breaks are data. run_column receives the file's name without its ending."""
    df = spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').csv(path)
    if run_column:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        df = df.withColumn(run_column, F.regexp_replace(name, r"\.[^.]*$", ""))
    return df


def read_splits(spark: SparkSession, path: str, column: str = "split_name") -> DataFrame:
    """A folder of ``split=NAME`` partitions; the split stays a partition filter."""
    df = spark.read.parquet(path)
    return df.withColumnRenamed("split", column) if "split" in df.columns else df


def read_json(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """JSON records, one a line (or whole files), with an explicit schema; what does not fit comes out null."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def load(spark: SparkSession, csv: str | None = None, folder: str | None = None, name: str | None = None, split: str | None = None, schema=None) -> DataFrame:
    """A CSV file where one is given (all text columns without a schema), else a Parquet table of a folder; with ``split``
    only that partition of ``split=NAME`` folders."""
    if csv:
        return read_csv(spark, csv, schema) if schema else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv)
    if not (folder and name):
        raise ValueError("give a CSV file, or a folder and the table's name")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.filter(F.col("split") == split) if split else df


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``, made and written first where there is none; for features that cost much."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values) of NumPy array files; each file is read by one task, one-dimensional ones as one row a number."""
    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(a), pa.string()), pa.array(np.arange(len(a))), pa.array(list(a), pa.list_(pa.float64()))], names=["file", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, row long, values array<double>")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files below a folder; each is read by the task that hashes it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
