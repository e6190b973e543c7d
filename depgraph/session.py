"""Session settings and durable intermediate tables.

Iterative jobs cut their lineage by writing Parquet tables below the directory
the session names in ``spark.checkpoint.dir``.  That directory is shared by all
executors, so a lost executor only costs a re-read.  Catalyst takes the size of a
stored table for its broadcast decisions; files are compressed, so the size is scaled
up by a factor that text columns in memory do not exceed.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs the next operator an extra exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # rows in memory are this many times larger than in a compressed file
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # for the same reason a task gets less of a file or of a shuffle: its sort or hash table must not spill
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.parquet.compression.codec": "zstd",
    # what a finished query shuffled is deleted at once; every step that is read again is a stored table
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators count on (skew splitting, UTC)."""
    for key, value in _SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Directory for intermediate tables: the session's own, or a fresh one in local mode."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    created = tempfile.mkdtemp(prefix="depgraph-")
    spark.sparkContext.setCheckpointDir(created)
    return created


def _scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/depgraph-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, location: str):
    """(path, file system) of a location, through the session's Hadoop settings."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, location: str) -> None:
    path, files = file_system(spark, location)
    files.delete(path, True)


def clear_intermediate(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results must be stored before."""
    discard(spark, _scratch_dir(spark))


def materialize(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared directory and read it back."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(
    df: DataFrame, label: str, path: str | None = None, **metrics: Column
) -> tuple[DataFrame, dict]:
    """As :func:`materialize`, with aggregates collected while the rows are written."""
    observed = Observation()
    columns = [column.alias(name) for name, column in metrics.items()]
    table = materialize(df.observe(observed, *columns), label, path)
    return table, observed.get


def materialize_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write independent tables side by side; their jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        written = pool.map(lambda item: materialize(item[1], item[0]), tables.items())
        return dict(zip(tables, written))


class Rounds:
    """The tables written by the rounds of one loop, readable as a single scan."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self._base = new_path(spark, label)
        self._paths: list[str] = []
        self._schema = None

    def __len__(self) -> int:
        return len(self._paths)

    def add(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        path = f"{self._base}/{len(self._paths):06d}"
        self._schema = df.schema
        if metrics:
            table, counts = materialize_with(df, "round", path, **metrics)
        else:
            table, counts = materialize(df, "round", path), {}
        self._paths.append(path)
        return table, counts

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*self._paths)

    def drop(self) -> None:
        """Delete the tables, once everything read from them has been written elsewhere."""
        discard(self._spark, self._base)
