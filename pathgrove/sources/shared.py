"""Tables in the folder that driver and executors share, and the files of any store that Spark reaches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pathgrove-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df there as Parquet, in folders by the columns given, and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    for written in _scratch.get()[-1:]:
        written.append(out)
    return out


_scratch: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written within are deleted at its end, so nothing that is read later may depend on them: what is to stay is written
    with ``outlasting``."""
    written: list[DataFrame] = []
    token = _scratch.set((*_scratch.get(), written))
    try:
        yield
    finally:
        _scratch.reset(token)
        release(*written)


def outlasting(df: DataFrame, name: str) -> DataFrame:
    """materialise, for a table that outlives the scratch that it is made in."""
    token = _scratch.set(_scratch.get()[:-1])
    try:
        return materialise(df, name)
    finally:
        _scratch.reset(token)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._written_to)


def _reached(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and time of change (ms) of what a folder holds; nothing if there is none."""
    fs, at = _reached(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _reached(spark, path)
    fs.delete(at, True)


def claim(spark: SparkSession, staged: str, target: str) -> bool:
    """Give the file at staged the name target too, whole and at once; False if the name is taken. On a local file system by a hard
    link, elsewhere by a rename that doesn't replace: both are atomic, so of two writers one gets the name."""
    fs, source = _reached(spark, staged)
    _, aim = _reached(spark, target)
    fs.mkdirs(aim.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.link(*(unquote(fs.makeQualified(p).toUri().getRawPath()) for p in (source, aim)))
        except FileExistsError:
            return False
        return True
    jvm, none = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(source), fs.makeQualified(aim), none)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True
