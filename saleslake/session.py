"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "saleslake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume; anything can be overridden by keyword.

    Shuffle partition counts are left to the cluster: adaptive execution coalesces
    small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Recording the call site of every column expression makes large plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local[*] session that names none falls back to a scratch folder, which goes with the process.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    Lost executors then re-read files instead of recomputing the lineage, and both
    uses of the result see identical rows.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Like ``durable``, as Parquet: for wide rows of which later steps read a few columns each, and for tables that
    are discarded again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask for a collection of the driver's garbage: Spark deletes the shuffle files of plans that nobody holds any
    more only then, and a long job would keep all of its shuffles on disk till its end."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table written by ``kept`` (or ``stored``) that is not read any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
