"""Small metadata files, through Hadoop's file systems so that any store works."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and from the root, as every machine reads it."""
    fs, target = _path(spark, path)
    return fs.makeQualified(target).toString().rstrip("/")


def resolved(spark: SparkSession, path: str) -> str:
    """``qualified``, and for a local path with links followed and dots taken out."""
    whole = qualified(spark, path)
    scheme, colon, rest = whole.partition(":")
    return f"{scheme}:{os.path.realpath('/' + rest.lstrip('/'))}" if colon and scheme == "file" else whole


def free_bytes(spark: SparkSession, path: str) -> int | None:
    """What the store says is free where the path lies or will lie; None if it does not tell."""
    fs, target = _path(spark, path)
    while target is not None and not fs.exists(target):
        target = target.getParent()
    free = int(fs.getStatus(target).getRemaining()) if target is not None else 0
    return free if 0 < free < 1 << 62 else None


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _path(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _path(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Indented, keys in their order, a newline at the end."""
    write_text(spark, path, json.dumps(value, indent=4, ensure_ascii=False) + "\n")


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _path(spark, source)
    if not fs.rename(a, _path(spark, target)[1]):
        raise OSError(f"cannot rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def make_parents(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.mkdirs(target.getParent())


def listing(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path below root, bytes) of every file, by path."""
    fs, target = _path(spark, root)
    base = fs.makeQualified(target).toString().rstrip("/") + "/"
    found, it = [], fs.listFiles(target, True)
    while it.hasNext():
        status = it.next()
        found.append((status.getPath().toString()[len(base) :], status.getLen()))
    return sorted(found)


def first_file(spark: SparkSession, root: str, suffix: str) -> str | None:
    """The first file below a folder by path that ends so and is not hidden; folders after it are not listed."""
    fs, target = _path(spark, root)
    if not fs.exists(target):
        return None
    below = [(s.getPath().getName() + ("/" if s.isDirectory() else ""), s) for s in fs.listStatus(target)]
    for name, s in sorted((x for x in below if x[0][:1] not in "._"), key=lambda x: x[0]):
        path = s.getPath().toString()
        if s.isDirectory():
            if found := first_file(spark, path, suffix):
                return found
        elif name.endswith(suffix):
            return path
    return None


_RUN = re.compile(r"(\d+)")


def natural_sort_key(name: str) -> list[tuple[int, int, str]]:
    """Digit runs compare as numbers, the rest in lower case."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in _RUN.split(name) if p]


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet; False if it is."""
    fs, target = _path(spark, path)
    try:
        stream = fs.create(target, False)
    except Exception as e:  # noqa: BLE001  stores name the error differently
        if fs.exists(target):
            return False
        raise OSError(str(e)) from e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def links(spark: SparkSession, root: str) -> list[str]:
    """Symbolic links below a local folder; other stores have none."""
    where = resolved(spark, root)
    if not where.startswith("file:"):
        return []
    found = []
    for folder, names, others in os.walk(where.removeprefix("file:")):
        found += [os.path.join(folder, n) for n in (*names, *others) if os.path.islink(os.path.join(folder, n))]
    return sorted(found)
