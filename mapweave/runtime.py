"""Session set-up and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which a query's shuffle files go when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where materialize() put the tables that are still held.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: int | str = 8, app: str = "mapweave", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='mapweave-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_folder(spark)}/mapweave-{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove what shared_path() named, before the session ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, *partition_by: str, collect: bool = True) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: any executor can read the files again after another one is lost. The shuffle files of
    this step aren't needed once the table stands; release() removes the table itself. An operator of many steps leaves plans and metrics of
    finished queries on the driver's heap, which grows to its limit before they are collected: they are collected here, so that
    a small driver lasts. Loops of short steps do without that (collect).
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path, partitionBy=list(partition_by) or None)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    if collect:
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing will read any more."""
    for table in tables:
        if path := _PLACES.pop(table, None):
            delete_path(table.sparkSession, path)
