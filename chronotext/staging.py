"""Tables written to the shared folder between steps, so that plans stay short and lost executors cost no recomputation."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a new temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chronotext-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Spark takes the shuffle files of a query away when the query has ended, and not when the driver comes to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What a query that starts here shuffles, goes when that query ends; for writes, whose plans run once."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


class Passing:
    """Tables that are staged for what is made of them, and go when it is there."""

    def __init__(self):
        self.paths: list[str] = []

    def alone(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, staged; all that was staged before it goes."""
        before = list(self.paths)
        out = staged(df, name)
        _drop(before)
        self.paths = [p for p in self.paths if p not in before]
        return out


_PASSING: ContextVar[Passing | None] = ContextVar("passing", default=None)


@contextmanager
def passing() -> Iterator[Passing]:
    """What is staged within goes at the end: for results that are written by then, and read none of it again."""
    here = Passing()
    outer = _PASSING.set(here)
    try:
        yield here
    finally:
        _PASSING.reset(outer)
        _drop(here.paths)


def _drop(paths: list[str]) -> None:
    for path in paths:
        where, at = fs.FileSystem.from_uri(path)
        with suppress(FileNotFoundError):
            where.delete_dir(at)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written under ``name`` and read back.  All that one application writes lies in one folder, which can go when it ends."""
    path = f"{folder(df.sparkSession)}/chronotext-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (here := _PASSING.get()) is not None:
        here.paths.append(path)
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
