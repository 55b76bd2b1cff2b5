"""Sessions, shared scratch space and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings that results rely on: UTC, AQE and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table up to which it is dealt anew; what moves is bounded by them.
SPREAD_BYTES = 256_000_000


def spread(df: DataFrame) -> DataFrame:
    """df on as many partitions as there are cores, if it is a table of at most SPREAD_BYTES that a scan gives fewer. Larger tables are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine names none, as in tests, a temporary folder is made and set once. On a cluster that is an error:
    a folder of the driver's own machine is not seen by its executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    home = f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    if getattr(spark, "_quarry_home", None) != home:
        fs, at = _file_system(spark, home)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        spark._quarry_home = home
    return f"{home}/{label}-{uuid.uuid4().hex}"


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "_quarry_path", None):
            fs, at = _file_system(frame.sparkSession, path)
            fs.delete(at, True)


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends at files that survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors when their PYTHONPATH does not already hold it."""
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark, "_quarry_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "quarry")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(archive)
    spark._quarry_shipped = True
