"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on: UTC instants and runtime re-planning.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("barlight")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, taken from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local test session) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="barlight-")
    sc.setCheckpointDir("file://" + folder)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Removes the shuffle files of a query when it ends; where the engine doesn't know it, it changes nothing.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage, survives the loss of executors and keeps columns compressed. Once the table
    stands nothing reads the shuffle files that led to it, so they are removed. The table goes with
    ``discard``, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    target = _path(spark, path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = _path(spark, table.written_to)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(table: DataFrame) -> int:
    """Bytes of a table made by ``written``."""
    target = _path(table.sparkSession, table.written_to)
    return target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
