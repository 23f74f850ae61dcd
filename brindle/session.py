"""A session with what the engine relies on."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "brindle", master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive plans and Arrow; conf adds settings, with _ for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temporary one only where none is set and all run on this machine; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    made = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder, of a size that the planner knows; options are the writer's."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
