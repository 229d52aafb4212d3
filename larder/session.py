"""Session settings the jobs rely on, and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method of more than 8000 bytes: past it operators generate their code in small methods each.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Parquet files are compressed and columns of few values take next to nothing, so their size says little of the rows that a
# copied join side becomes: the driver and every task would hold some forty times as much. Up to this many bytes of file.
COPIED_UNREAD = 256 << 10
# A plan of many joins holds many copies at once, and both sides are shuffled by the time that AQE knows their size. Up to this many bytes of rows.
COPIED_MEASURED = 2 << 20


def local_session(cores: str = "*", partitions: int = 8, app: str = "larder", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings whose value changes results (time zone) or plans (AQE)."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return measured_copies(spark)


def measured_copies(spark: SparkSession) -> SparkSession:
    """Bounds for copied join sides, lower ones of the session's own kept: ``COPIED_UNREAD`` for sizes of files, ``COPIED_MEASURED`` for those that AQE has measured."""
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    bound = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if bound > COPIED_UNREAD:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, str(min(bound, COPIED_MEASURED)))
        spark.conf.set(static, str(COPIED_UNREAD))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that ``spark.checkpoint.dir`` names; only a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larder-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Rows stored once in the shared folder and read back: no lineage to replay if an executor is lost.

    Stored as compressed Parquet, so what is written is a fraction of a checkpoint of plain rows, later reads take only
    their columns, and Spark knows the size (small tables are copied in joins instead of shuffling the other side).
    """
    path = shared_folder(df.sparkSession, "durable")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
