"""Session settings and tables that end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive plans, Arrow transfers."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("panelforge")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a local master (tests), a folder of this process. A cluster
    must name its folder: executors would not see one of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The setting by which Spark deletes a query's shuffle files when it is over.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: the lineage ends, and later joins may split skewed keys. With
    ``free`` the shuffle files of the write are deleted when it is over, not when the driver happens to collect its garbage."""
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREED, None)
    if free:
        conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and before is None:
            conf.unset(FREED)
        elif free:
            conf.set(FREED, before)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def replace_folders(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Renames each new folder to its place, after all of them are written. What stood there is set aside first and put back
    if a rename fails, so that a reader finds the old ones or the new ones, but for the moment between two renames."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf, moved = spark._jsc.hadoopConfiguration(), []
    try:
        for new, place in pairs:
            fs = path(place).getFileSystem(conf)
            aside = f"{place}.{uuid.uuid4().hex}"
            old = fs.exists(path(place))
            if old and not fs.rename(path(place), path(aside)):
                raise OSError(f"cannot set {place} aside")
            moved.append((fs, new, place, aside if old else None))
            if not fs.rename(path(new), path(place)):
                raise OSError(f"cannot put {new} in its place")
    except Exception:
        for fs, new, place, aside in reversed(moved):
            if fs.exists(path(place)):
                fs.rename(path(place), path(new))
            if aside is not None:
                fs.rename(path(aside), path(place))
        raise
    for fs, _, _, aside in moved:
        if aside is not None:
            fs.delete(path(aside), True)
