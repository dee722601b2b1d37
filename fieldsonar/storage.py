"""Intermediate tables in the folder that driver and executors share: they cut the lineage and survive a lost executor."""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder in the warehouse where it is unset.

    A warehouse on a local disk is taken under a local master only: on a cluster each executor would write to its own.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if is_local(top) and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"spark.checkpoint.dir is not set and the warehouse, {top}, is a local folder, which executors do not share")
    return f"{top}/_fieldsonar"


def is_local(folder: str) -> bool:
    return folder.startswith("file:") or "://" not in folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that written() and owned() have made, in order; each thread, so each of queries that run side by side, has its own list.
_MADE: contextvars.ContextVar[list[str]] = contextvars.ContextVar("made")


def _made() -> list[str]:
    if (own := _MADE.get(None)) is None:
        _MADE.set(own := [])
    return own


def owned(folder: str) -> str:
    """folder, which swept() deletes with the tables."""
    _made().append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, so that a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    owned(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind tables made by written(), once nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark, folder)


def made() -> int:
    """How many folders this thread has made so far: a mark for swept()."""
    return len(_made())


def swept(spark: SparkSession, since: int, keep: DataFrame) -> DataFrame:
    """keep, a table made by written(); all other folders that this thread made since a mark are deleted, as nothing reads them any more."""
    own = _made()
    mine = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    for folder in own[since:]:
        if folder.rsplit("/", 1)[-1] not in mine:
            _delete(spark, folder)
    own[since:] = [f for f in own[since:] if f.rsplit("/", 1)[-1] in mine]
    return keep


def settled(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same query, (spark, ...) -> DataFrame; where it has made tables its result is written and they are deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **more) -> DataFrame:
        mark = made()
        out = query(spark, *args, **more)
        return out if made() == mark else swept(spark, mark, written(out, query.__name__))

    return run
