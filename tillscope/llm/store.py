"""Tables that an operator writes on the way, in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillscope.plans.session import shared_folder

#: Spark's setting to drop the shuffle files of a query when it ends, not when the driver
#: happens to collect its garbage
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(df: DataFrame, name: str) -> str:
    """A fresh folder under the shared one; no two runs meet in it."""
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files behind."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it from there.

    This cuts the lineage: a lost executor costs a re-read, never a second run of
    what came before. So the shuffle files of the write go when it ends. The Parquet
    files stay in the shared folder for its owner to clear.
    """
    path = scratch_path(df, name)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
