"""What the operators of this subpackage share: tables, shared scratch space, byte-balanced Arrow slices."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("sievework.scratch", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("sievework.scratch", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder; cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what stored() has written for df, once nothing that is yet to run reads it."""
    session = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = session._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; before the first, the worker gives back the Arrow memory that its earlier tasks have freed, which its pool would keep."""
    pa.default_memory_pool().release_unused()
    yield from batches


def byte_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about `limit` bytes each; a longer value is a range of its own."""
    size = at = 0
    for i in range(len(column)):
        n = column[i].as_buffer().size if column[i].is_valid else 0
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(column):
        yield at, len(column)


def texts(column: pa.Array, start: int, stop: int) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in column.slice(start, stop - start).to_pylist()]
