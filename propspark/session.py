"""Session helpers: the shared folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_TYPES = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
    "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only made up when the master itself is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="propspark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/propspark-{name}-{uuid.uuid4().hex}"


_written: list[str] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` wrote inside the block when it ends.

    Results that read them must be written or collected inside the block.
    """
    kept = len(_written)
    try:
        yield
    finally:
        hadoop = spark._jsc.hadoopConfiguration()
        for path in _written[kept:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)
        del _written[kept:]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but the result is columnar, so later
    passes over a few columns read only those, and it survives executor loss.
    """
    path = new_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[tuple], **kinds: str) -> DataFrame:
    """A driver-made table of a few rows (one per feature or so) with declared column types.

    It arrives as Arrow and becomes a local relation: reading it starts no job and
    its size is known to the planner.
    """
    columns = {name: pa.array([r[i] for r in rows], ARROW_TYPES[kind]) for i, (name, kind) in enumerate(kinds.items())}
    return spark.createDataFrame(pa.table(columns))
