"""Metadata beside a dataset: edits, pivots and the like as JSON with the dataset's fingerprint; a stale one is refused."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class StaleSidecar(ValueError):
    pass


def fingerprint(df: DataFrame) -> str:
    """Of the schema and the files' names: cheap, and different after any rewrite."""
    return hashlib.sha256(json.dumps([df.schema.json(), sorted(df.inputFiles())]).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(spark: SparkSession, path: str, base: DataFrame, content: dict) -> None:
    """Written under another name first and then renamed, so a reader never sees half of it."""
    fs, p = _fs(spark, path)
    _, temp = _fs(spark, path + ".tmp")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"base": fingerprint(base), "content": content}).encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(temp, p)


def load(spark: SparkSession, path: str, base: DataFrame) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    body = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if body["base"] != fingerprint(base):
        raise StaleSidecar(f"{path} belongs to other data")
    return body["content"]


def edits_to_json(edits: dict) -> list:
    return [[r, c, e.value, e.formula, e.error] for (r, c), e in sorted(edits.items())]


def edits_from_json(rows: list) -> dict:
    from ..workbook import Edit

    return {(r, c): Edit(v, f, e) for r, c, v, f, e in rows}


class Autosave:
    """A copy of the unsaved state beside the sidecar, written at most every ``every`` seconds, for recovery after a crash."""

    def __init__(self, spark: SparkSession, path: str, base: DataFrame, every: float = 30.0, clock=time.monotonic):
        self.spark, self.path, self.base, self.every, self.clock = spark, path + ".autosave", base, every, clock
        self.last: float | None = None

    def note(self, content: Callable[[], dict]) -> bool:
        """After an edit: writes the state if the last copy is old enough. ``content`` is only asked for then."""
        now = self.clock()
        if self.last is not None and now - self.last < self.every:
            return False
        save(self.spark, self.path, self.base, content())
        self.last = now
        return True

    def recover(self) -> dict | None:
        """The state of a session that ended without saving, or None. A copy that belongs to other data is left alone."""
        try:
            return load(self.spark, self.path, self.base)
        except StaleSidecar:
            return None

    def saved(self) -> None:
        """After a real save the copy goes."""
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, False)
        self.last = None
