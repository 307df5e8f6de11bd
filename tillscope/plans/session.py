"""Session settings and tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MB = 1 << 20
#: what one shuffle partition should hold before AQE merges small ones
PARTITION_BYTES = 256 * MB
#: the driver tracks every map task times every partition; beyond these,
#: partitions grow and spill instead
MAX_PARTITIONS = 50_000
MAX_SCAN_TASKS = 200_000
#: what a task that joins and adds up lines should hold, some hundred bytes each
LINES_PER_TASK = 1_500_000


def scale_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Runtime SQL settings for ``input_bytes`` of tables on ``cores`` cores.

    Partitions start small enough to fit an executor core; AQE merges the ones
    that turn out small and splits join partitions that turn out skewed.
    """
    partitions = min(MAX_PARTITIONS, max(2 * cores, -(-input_bytes // PARTITION_BYTES)))
    split = max(128, -(-input_bytes // (MAX_SCAN_TASKS * MB)))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": f"{split}m",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{PARTITION_BYTES // MB}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key also where an aggregate on the join key follows
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # the small first-level map only costs when there are millions of groups
        "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def tasks_for(lines: DataFrame) -> int:
    """How many tasks keep each at ``LINES_PER_TASK``; counts the rows, of Parquet from its footers."""
    return min(MAX_PARTITIONS, max(1, -(-lines.count() // LINES_PER_TASK)))


def spread(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """``df`` dealt by ``key`` over ``tasks``, where the session's partitions are fewer.

    What is joined to it on the key is dealt alike. Otherwise Spark is left to choose.
    """
    conf = df.sparkSession.conf
    initial = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    own = int(initial or conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key) if tasks > own else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="tillscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    Whatever reads it, however often, reads the same rows; what came before runs once, also
    when an executor is lost later. The folder's owner clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
