"""Stored tables in versions that become visible at once.

The rows of a version go to a new folder. A small manifest, written last, names the folders that make up the
version; readers open the newest complete manifest. A job that dies leaves folders no manifest names, and
readers that started before keep the files of their version. Files go through Hadoop's file system, so the
path may be anything Spark writes to; manifests are created exclusively, so of two writers one fails.
"""

import json
import uuid
from dataclasses import dataclass

MANIFESTS = "_manifests"
_END = "complete"


@dataclass(frozen=True)
class Snapshot:
    """A version: its number and its folders by bucket (or ``""``), relative to the table's path; null if empty."""

    number: int
    folders: dict


def _open(spark, path):
    """Hadoop's file system of a path, and how it makes paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def _names(spark, path):
    files, make = _open(spark, path)
    if not files.exists(make(path)):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(make(path)))


def _numbers(spark, path):
    return sorted(int(name) for name in _names(spark, f"{path}/{MANIFESTS}") if name.isdigit())


def _read(spark, path, number):
    files, make = _open(spark, path)
    stream = files.open(make(f"{path}/{MANIFESTS}/{number:08d}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    body, _, end = text.rpartition("\n")
    return Snapshot(number, json.loads(body)) if end == _END else None


def snapshot(spark, path, number=None):
    """The version of that number, or the newest complete one."""
    for candidate in [number] if number else reversed(_numbers(spark, path)):
        found = _read(spark, path, candidate)
        if found:
            return found
    raise FileNotFoundError(f"no complete version {number or ''} at {path}")


def fresh_folder(spark, path):
    """The number and a new folder for the next version; rows in it are seen by nobody before ``publish``."""
    number = max(_numbers(spark, path), default=0) + 1
    return number, f"version={number:08d}-{uuid.uuid4().hex[:8]}"


def publish(spark, path, number, folders):
    """Make a version visible. Fails if another writer has published that number meanwhile."""
    files, make = _open(spark, path)
    stream = files.create(make(f"{path}/{MANIFESTS}/{number:08d}"), False)
    try:
        stream.write(bytearray(f"{json.dumps(folders)}\n{_END}".encode()))
    finally:
        stream.close()


def bucket_folders(spark, path, folder, column):
    """The folders that a write with ``partitionBy(column)`` has made, by bucket; at most one per bucket."""
    prefix = f"{column}="
    return {name.removeprefix(prefix): f"{folder}/{name}" for name in _names(spark, f"{path}/{folder}") if name.startswith(prefix)}


def remove_unused(spark, path, keep=2):
    """Delete the folders that none of the newest ``keep`` versions names, and the older manifests.

    Not while a writer is at work: its folder is not named yet.
    """
    files, make = _open(spark, path)
    numbers = _numbers(spark, path)
    complete = [n for n in numbers if _read(spark, path, n)]
    kept = complete[-keep:]
    inside = {folder for n in kept for folder in _read(spark, path, n).folders.values() if folder}
    named = {folder.split("/")[0] for folder in inside}
    removed = []
    for name in _names(spark, path):
        if not name.startswith("version="):
            continue
        unused = [name] if name not in named else []
        if name in named and name not in inside:
            unused = [f"{name}/{part}" for part in _names(spark, f"{path}/{name}") if "=" in part and f"{name}/{part}" not in inside]
        removed += unused
    for name in removed:
        files.delete(make(f"{path}/{name}"), True)
    for number in numbers:
        if number not in kept and number < max(kept, default=0):
            files.delete(make(f"{path}/{MANIFESTS}/{number:08d}"), False)
    return removed
