"""Numbered manifests in a shared folder: a change is visible once its manifest is, and each number is written once.

Writers prepare their files, then create the next number's manifest if nobody has; who loses looks at the new state and tries again, RETRIES
times at most, and then fails with nothing half visible."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

RETRIES = 8
_DIGITS = 12


class Refused(RuntimeError):
    """Others kept on changing the state; nothing was written."""


def _path(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _file(root: str, number: int) -> str:
    return f"{root}/manifests/{number:0{_DIGITS}d}.json"


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last manifest's number and contents; 0 and nothing where there is none."""
    folder, fs = _path(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return 0, {}
    numbers = [name[:_DIGITS] for name in (s.getPath().getName() for s in fs.listStatus(folder)) if name.endswith(".json") and name[:_DIGITS].isdigit()]
    if not numbers:
        return 0, {}
    number = int(max(numbers))
    there, fs = _path(spark, _file(root, number))
    stream = fs.open(there)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(text)


def publish(spark: SparkSession, root: str, number: int, body: dict) -> bool:
    """Create a number's manifest, whole and at once; False if it is there already."""
    target, fs = _path(spark, _file(root, number))
    if fs.exists(target):
        return False
    draft, _ = _path(spark, f"{root}/manifests/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(body).encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename would overwrite here, a link does not
            nio = spark._jvm.java.nio.file
            nio.Files.createLink(spark._jvm.java.io.File(target.toUri().getPath()).toPath(), spark._jvm.java.io.File(draft.toUri().getPath()).toPath())
        else:
            fs.rename(draft, target)  # refuses an existing target
        return _same(spark, fs, target, body)
    except Exception as taken:
        if "FileAlreadyExists" not in str(taken):
            raise
        return False
    finally:
        fs.delete(draft, False)


def _same(spark: SparkSession, fs, target, body: dict) -> bool:
    """Whether a manifest is the one just written: some stores report a refused rename by False alone."""
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") == json.dumps(body)
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, attempt: Callable[[int, dict], dict | None], retries: int = RETRIES) -> int:
    """The number under which a change was published. attempt makes the new contents from the last manifest's number and contents, or None if nothing is to change."""
    for _ in range(retries + 1):
        number, body = latest(spark, root)
        changed = attempt(number, body)
        if changed is None:
            return number
        if publish(spark, root, number + 1, changed | {"by": uuid.uuid4().hex}):
            return number + 1
    raise Refused(f"{root}: the state moved {retries + 1} times")
