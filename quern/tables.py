"""Test tables by name, and tables cut off from their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def streamed(spark: SparkSession, path: str, columns: list[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files at path as a stream; path is a folder or a single file. Timestamps are read as UTC instants."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    one = files.exists(where) and files.getFileStatus(where).isFile()
    rows = spark.read.parquet(path)
    schema = rows.select(*columns).schema if columns else rows.schema
    source = spark.readStream.schema(schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    # streams read folders: of a single file a pattern that matches it only
    stream = source.parquet(f"{path[:-1]}[{path[-1]}]" if one else path)
    plain = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else stream


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one of this machine in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass  # the session is gone; the folder's owner clears it


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as a table in the shared folder and read again: no lineage, nothing recomputed, survives lost executors."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
