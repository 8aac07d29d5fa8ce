"""Parquet tables and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 64 << 20
BATCH_ROWS = 1_000
_LOCAL: dict[str, str] = {}


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """A table of at most ``most`` bytes in few files, dealt over all cores; any larger one as it is.

    A small table in one file is one task, whatever the work on its rows; dealing out so few bytes
    costs next to nothing. Beyond the bound, tables are never shuffled here, however few files or many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns (default: all) of the table ``name`` under a folder.

    Rows go to Python workers in Arrow batches of BATCH_ROWS, unless the session has a size of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Without it a session in local mode, which has one machine only, gets a temporary folder that goes with the
    process. On a cluster executors would each write to a disk of their own, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="irengine-")
        atexit.register(shutil.rmtree, _LOCAL["root"], ignore_errors=True)
    return f"file://{_LOCAL['root']}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
