"""Files that tasks open themselves, by the same paths that Spark takes."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import BinaryIO

import pyarrow.fs as pafs

#: Names that Hadoop's connectors give to a store, and what Arrow calls it.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}
_CHUNK = 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path within it) of a URI or a local path."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?=/)", path)
    if m is None:
        return pafs.LocalFileSystem(), path
    scheme = m.group(1).lower()
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + path[m.end() :].lstrip("/")
    return pafs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + path[m.end() - 1 :])


def reader(path: str) -> BinaryIO:
    """A seekable file; no more of it is read than asked for."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def exists(path: str) -> bool:
    fs, inner = filesystem(path)
    return fs.get_file_info(inner).type == pafs.FileType.File


def delete(path: str) -> None:
    """Takes a file away; one that is not there is no error, so that a task may be repeated."""
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type == pafs.FileType.File:
        fs.delete_file(inner)


def size(path: str) -> int | None:
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    return info.size if info.type == pafs.FileType.File else None


def attempt_of(inner: str, attempt: int) -> str:
    """The hidden name under which one attempt of a task writes a file."""
    folder, _, name = inner.rpartition("/")
    return f"{folder}/.{name}.{attempt}.tmp" if folder else f".{name}.{attempt}.tmp"


def commit(fs: pafs.FileSystem, made: str, target: str) -> None:
    """Gives a whole file its name; that of an attempt lost before, with the same content, makes room."""
    try:
        fs.move(made, target)
    except OSError:
        if fs.get_file_info(target).type != pafs.FileType.File:
            raise
        fs.delete_file(target)
        fs.move(made, target)


def write(path: str, attempt: int, fill: Callable[[BinaryIO], None]) -> int:
    """Fills a file under the attempt's name, then names it; returns its bytes.  A failed attempt leaves nothing."""
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    made = attempt_of(inner, attempt)
    try:
        with fs.open_output_stream(made) as out:
            fill(out)
    except BaseException:
        if fs.get_file_info(made).type == pafs.FileType.File:
            fs.delete_file(made)
        raise
    written = fs.get_file_info(made).size
    commit(fs, made, inner)
    return written


def copy(source: BinaryIO, out: BinaryIO) -> None:
    """All bytes, a bounded piece at a time."""
    source.seek(0)
    while data := source.read(_CHUNK):
        out.write(data)
