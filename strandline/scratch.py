"""Where work that several machines share is written between steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINTS = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder if all of Spark runs on this machine, else an error."""
    folder = spark.conf.get(CHECKPOINTS, None) or spark.sparkContext.getConf().get(CHECKPOINTS)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINTS} to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), f"strandline-{uuid.uuid4().hex[:8]}")
        spark.conf.set(CHECKPOINTS, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nobody else uses."""
    return f"{shared_folder(spark)}/strandline/{name}-{uuid.uuid4().hex}"
