"""Versions of a stored table: each is one small file that names what belongs to it, there whole or not at all.

Data files are written first, under names of their own, and nothing reads them before a commit names
them. Two writers that prepared the same version can't both publish it: the second is told.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _store(spark: SparkSession, root: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    return hadoop, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published ones, in order."""
    hadoop, _, store = _store(spark, root)
    folder = hadoop.Path(f"{root}/commits")
    if not store.exists(folder):
        return []
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))


def content(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Any] | None:
    """What a version, or else the last one, holds; None where there is none."""
    there = versions(spark, root)
    if version is None and there:
        version = there[-1]
    if version not in there:
        return None
    return json.loads(spark.read.text(f"{root}/commits/{version:012}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, version: int, said: dict[str, Any]) -> bool:
    """Make a version of it; False if another writer has made that version."""
    hadoop, _, store = _store(spark, root)
    ready, final = hadoop.Path(f"{root}/commits/.{uuid.uuid4().hex}"), hadoop.Path(f"{root}/commits/{version:012}.json")
    out = store.create(ready)
    out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    unless_there = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    unless_there[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(ready, final, unless_there)
    except Exception:
        store.delete(ready, False)
        if store.exists(final):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    hadoop, _, store = _store(spark, path)
    store.delete(hadoop.Path(path), True)
