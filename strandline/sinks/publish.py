"""Whole datasets appear at their destination or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources import files


def check_paths(spark: SparkSession, destination: str, sources: list[str], *, need_bytes: int | None = None) -> None:
    """A destination may neither hold a source nor lie inside one, by whole paths without links; and the space must do.

    Free space is asked of the store; one that has no bound, or does not tell, passes.
    """
    d = files.resolved(spark, destination) + "/"
    for s in sources:
        other = files.resolved(spark, s) + "/"
        if d.startswith(other) or other.startswith(d):
            raise ValueError(f"{destination} and the source {s} overlap")
    if need_bytes is not None:
        free = files.free_bytes(spark, destination)
        if free is not None and free < need_bytes:
            raise ValueError(f"{need_bytes} bytes are needed at {destination}, {free} are free")


def publish(spark: SparkSession, destination: str, build: Callable[[str], None], *, overwrite: bool = False) -> None:
    """Runs ``build`` on a hidden sibling folder and renames that to the destination.

    What was there before is kept aside until the rename has succeeded and is
    put back if it fails; a failed build leaves nothing.
    """
    destination = destination.rstrip("/")
    parent, _, name = destination.rpartition("/")
    if files.exists(spark, destination) and not overwrite:
        raise FileExistsError(destination)
    tag = uuid.uuid4().hex[:12]
    staging, backup = f"{parent}/.{name}.{tag}", f"{parent}/.{name}.{tag}.old"
    files.make_parents(spark, staging)
    try:
        build(staging)
        moved = files.exists(spark, destination)
        if moved:
            files.rename(spark, destination, backup)
        try:
            files.rename(spark, staging, destination)
        except Exception:
            if moved:
                files.rename(spark, backup, destination)
            raise
        if moved:
            files.delete(spark, backup)
    except Exception:
        files.delete(spark, staging)
        raise
