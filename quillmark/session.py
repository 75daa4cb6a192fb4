"""Session defaults: adaptive execution, UTC, and a local master only when none is configured."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A folder of our own, where the session names none.
_own: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, one of our own
    on a local master only."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            _own = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        root = _own
    return f"{root.rstrip('/')}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"


def expire(spark: SparkSession, path: str) -> None:
    """Have a written folder deleted when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once and read from there: every later branch starts from the files,
    which are deleted when the driver ends."""
    path = shared_folder(df.sparkSession, "written")
    df.write.parquet(path)
    expire(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
