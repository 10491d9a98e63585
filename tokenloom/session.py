"""Session defaults and the shared-folder lineage cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings a job wants on a real cluster.  Shuffle width is left to AQE there:
#: the initial number is high and small partitions are coalesced at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column expression slows large projections down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tokenloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; callers' own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Where none is set, a local master gets a temporary folder; on a cluster that would
    scatter files over the machines, so it is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tokenloom-ckpt-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made.

    Used between rounds of an iterative job and where one result feeds several
    branches.  The copy lives on reliable storage, so losing an executor never
    loses it.  It is a table: a checkpoint to reliable storage makes its rows twice,
    once to look at them and once to write them.
    """
    return stage(df)


#: Files that a table of few rows has at most, and rows of a file from which on it has more.
FEW_FILES, FILE_ROWS = 8, 1 << 16


def stage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For wide results that feed several branches: readers of the table fetch only
    the columns and row groups they need, which a checkpoint cannot offer.  A table known
    to have at most ``rows`` rows, cheap to make, is written in few files: otherwise it has
    one for each shuffle partition, and so has the shuffle of every step that reads it.
    """
    if rows is not None:
        df = df.coalesce(max(FEW_FILES, rows // FILE_ROWS))
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What opening one more file counts for, in bytes, where a folder holds many small ones.
SMALL_FILE_BYTES = "64k"


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Read folders of many small files in tasks of many files.

    Spark counts 4 MiB for each, which makes a task of every 32 files however short they
    are; the shuffles and tables behind them then have as many pieces.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, SMALL_FILE_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
