"""Session settings used by the bench and the tests; a cluster brings its own session."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDERS: dict[str, str] = {}  # of local sessions without the setting, by application


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("entitylake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir, which driver and executors share.

    Only a local session may go without the setting: it then gets one temporary folder of its own.
    Any other master without the setting is refused, because executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDERS.setdefault(spark.sparkContext.applicationId, "") or _new_folder(spark)


def _new_folder(spark: SparkSession) -> str:
    root = LOCAL_FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return root


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a result that several branches read and read it back from the shared folder.

    The branches then neither repeat its work nor depend on the executors that did it. `folder`
    overrides the session's checkpoint folder. The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{folder or checkpoint_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = file_system(spark, path)
    system.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now.

    It drops them once the driver's garbage collection has found their plans unused, which may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete the files of a stored() result that nothing reads any more."""
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        target, system = file_system(df.sparkSession, path)
        system.delete(target, True)


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())
