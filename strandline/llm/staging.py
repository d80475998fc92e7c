"""Tables written between the steps of an operator, in the folder all machines share."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, shared_folder

_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses below the shared folder; it goes when the driver ends."""
    path = new_folder(spark, name)
    if not _made:
        atexit.register(_sweep)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here.

    The files outlive lost executors, and what follows reads only the columns it needs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids up to which a side is broadcast: 16 MB of longs.
BROADCAST_IDS = 2_000_000


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A broadcast hint if the rows have been counted and are few; else the frame as it is, for a shuffle join."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _made.pop(spark.sparkContext.applicationId, []):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


__all__ = ["BROADCAST_IDS", "drop", "new_path", "quoted", "shared_folder", "small", "stage", "table", "unused"]


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
