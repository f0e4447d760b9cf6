"""Tables whose content is what their newest manifest lists.

Data is written under a new name first; then one small file is created that lists what counts.  A
reader sees the content before or after a commit and nothing between, and what a lost job wrote is
never listed.  Manifests are numbered and created only if their number is free, so of two writers one
has to start from the other's manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_FOLDER = "_manifests"
_TRIES = 100


def new_version() -> str:
    return uuid.uuid4().hex


def _files(spark: SparkSession, folder: str):
    """The file system of a folder and the folder of its manifests; any store that Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{_FOLDER}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read(spark: SparkSession, fs, path) -> dict | None:
    """The manifest in a file; None if its writer did not finish it."""
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _numbers(fs, path) -> list[int]:
    if not fs.exists(path):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(path))
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), reverse=True)


def _path(spark: SparkSession, folder: str, number: int):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_FOLDER}/{number:012d}.json")


def _newest(spark: SparkSession, fs, folder: str, numbers: list[int]) -> dict:
    for number in numbers:
        if (found := _read(spark, fs, _path(spark, folder, number))) is not None:
            return found
    return {}


def current(spark: SparkSession, folder: str) -> dict:
    """What the newest whole manifest says; empty before the first commit."""
    fs, path = _files(spark, folder)
    return _newest(spark, fs, folder, _numbers(fs, path))


def commit(spark: SparkSession, folder: str, change: Callable[[dict], dict | None]) -> dict:
    """Replace the manifest by ``change`` of the current one; None leaves it.  Returns what counts now."""
    fs, path = _files(spark, folder)
    for _ in range(_TRIES):
        numbers = _numbers(fs, path)
        before = _newest(spark, fs, folder, numbers)
        after = change(before)
        if after is None:
            return before
        try:
            stream = fs.create(_path(spark, folder, max(numbers, default=0) + 1), False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception) and "already exists" not in str(error.java_exception):
                raise
            continue            # another writer was first: start from its manifest
        try:
            stream.write(bytearray(json.dumps(after).encode()))
        finally:
            stream.close()
        return after
    raise RuntimeError(f"no manifest could be committed under {folder}")
