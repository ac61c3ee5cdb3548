"""Session construction and the few cluster-wide helpers that operators share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "scholark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, Arrow transfer and adaptive execution; ``conf`` wins over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local master may do without one (tests, local runs): there a temporary folder is made and set. On a cluster such
    a folder would lie on one machine, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scholark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, kind: str = "cut") -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    system, jpath = _file_system(spark, path)
    system.deleteOnExit(jpath)
    return path


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def cut_lineage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read and no recomputation, iterative plans stay short, and values that are
    assigned once (ids) stay the same. Parquet keeps the copy compressed and column-pruned. The shuffles behind the
    copy are of no more use; a collection of the driver's garbage lets Spark drop their files.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _collect_garbage(spark)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._cut_path = path
    return copy


#: Seconds between two collections of the driver's garbage.
GARBAGE_EVERY = 2.0
_collected = [0.0]


def _collect_garbage(spark: SparkSession) -> None:
    if time.monotonic() - _collected[0] >= GARBAGE_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def release(df: DataFrame) -> None:
    """Delete the files behind a ``cut_lineage`` copy that no later plan reads."""
    if path := getattr(df, "_cut_path", None):
        system, jpath = _file_system(df.sparkSession, path)
        system.delete(jpath, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which operators size their own salts and blocks."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
