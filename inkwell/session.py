"""Sessions, table reading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "inkwell", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session you are given."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one, removed at exit, only in local mode.

    Elsewhere an unset folder is an error: executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "inkwell-checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows up to which a counted side of a join of a few short columns is sent to every executor.
SMALL = 200_000


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A join side that is counted first: broadcast where it has no more than ``rows`` rows, else left to the optimizer.

    It keeps the other side, when that carries long texts, from being shuffled
    for a lookup; beyond the bound both sides are shuffled as usual.
    """
    counted = cut(df)
    return F.broadcast(counted) if counted.limit(rows + 1).count() <= rows else counted
