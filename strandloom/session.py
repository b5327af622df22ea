"""Session defaults and the few helpers every operator shares: cutting lineage in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have before `bounded_broadcast` stops hinting a broadcast.
BROADCAST_ROWS = 100_000


def build_session(app: str = "strandloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, last-wins map keys."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local master, where all tasks see one disk, gets a temporary one if it is unset; on a
    cluster that is an error, for the executors would write to disks the others cannot read."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not is_local(sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandloom-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """Whether the tasks run in the driver's own process; local-cluster has processes of its own."""
    return master == "local" or master.startswith("local[")


_folders: dict[str, tuple] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended
        pass


def tables_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables and files inside the shared checkpoint folder; it is removed when the session ends."""
    root = checkpoint_dir(spark).rstrip("/") + "/tables"
    if root not in _folders:
        _folders[root] = (spark,)
        atexit.register(_remove, spark, root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back. Compressed, columnar, survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold no more than `rows` rows, else as it is (shuffle join, AQE splits skew)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
