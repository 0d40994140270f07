"""Session defaults and the folder shared by all executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skeinworks")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below that of ``spark.checkpoint.dir``; it is removed when the program ends.

    Where that is unset a session on a single machine (master ``local``) gets a temporary folder; others must set it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _OWN:
        return _OWN[sc.applicationId]
    given = sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if given or now.isDefined():
        folder = f"{(given or now.get()).rstrip('/')}/skeinworks-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(clear, spark)
    elif sc.master == "local" or sc.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="skeinworks-")
        atexit.register(shutil.rmtree, own, True)
        folder = f"file://{own}"
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    _OWN[sc.applicationId] = folder
    return folder


def clear(spark: SparkSession) -> None:
    """Removes what ``stash`` has written so far; tables that were read back from it must not be used any more."""
    folder = _OWN.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc is not None else None
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
