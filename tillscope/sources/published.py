"""Folders that readers see all at once: new ones are written aside, then published.

A publication is one small JSON file with a row per part. It names the folder that holds the
part from then on; nothing that is published is ever written over, so a writer that fails
leaves readers with what they had. One writer at a time. Folders that no publication names
any more are for the owner to delete.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_ROWS = "version BIGINT, part STRING, folder STRING"


def _rows(spark: SparkSession, root: str) -> list:
    """One row per part and publication: the log grows with the publications, not the data."""
    try:
        return spark.read.schema(_ROWS).json(f"{root}/published").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """part -> full path of its folder, by the latest publication that names the part."""
    found = {r["part"]: r["folder"] for r in sorted(_rows(spark, root), key=lambda r: r["version"])}
    return {part: f"{root}/{folder}" for part, folder in sorted(found.items()) if folder}


def new_folder() -> str:
    """A folder under the root that no earlier or failed writer used."""
    return f"versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, parts: dict[str, str | None]) -> None:
    """Make ``parts`` current, all at once; None takes a part away."""
    version = max((r["version"] for r in _rows(spark, root)), default=0) + 1
    rows = [(version, part, folder) for part, folder in parts.items()]
    spark.createDataFrame(rows, _ROWS).coalesce(1).write.mode("append").json(f"{root}/published")
