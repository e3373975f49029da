"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="attestry-")
    sc.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/attestry-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs no more than its running tasks."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that is sent to every task, at most.
SENT = 1_000_000


def sent(df: DataFrame, name: str) -> DataFrame:
    """df written, and sent to every task of a join if its rows are few; else the join deals both sides."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= SENT else out


def _path(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _path(spark, path)
    return store.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    return spark.read.text(path, wholetext=True).first()[0]


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the driver's own file system, if it is one."""
    store, p = _path(spark, path)
    return p.toUri().getPath() if store.getUri().getScheme() == "file" else None


def _temporary(spark: SparkSession, path: str, text: str) -> str:
    """A new file beside path with a small text."""
    name = f"{path}.{uuid.uuid4().hex}"
    if local := _local(spark, name):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "w", encoding="utf-8") as file:
            file.write(text)
        return name
    store, p = _path(spark, name)
    out = store.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return name


def _rename(spark: SparkSession, from_: str, to: str, over: bool) -> None:
    """Rename a file in one step: a reader of the new name finds the old file or the new one. Of a distributed file system
    that is its own rename; on the local one Hadoop's would delete first, so it is the operating system's."""
    if local := _local(spark, to):
        source = _local(spark, from_)
        if over:
            os.replace(source, local)
        else:
            os.link(source, local)
            os.remove(source)
        return
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if over else kind.NONE
    p = jvm.org.apache.hadoop.fs.Path
    store, source = _path(spark, from_)
    uri = store.makeQualified(source).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(p(from_), p(to), options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver under a temporary name that then takes the place of what bore its own."""
    _rename(spark, _temporary(spark, path, text), path, over=True)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, unless its name is taken: of several writers of one name one succeeds, and no reader sees part of it."""
    temporary = _temporary(spark, path, text)
    try:
        _rename(spark, temporary, path, over=False)
        return True
    except FileExistsError:
        pass
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
    delete(spark, temporary)
    return False


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    store, p = _path(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []


def ages(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """(name, time of the last change in seconds) of what is in a folder."""
    store, p = _path(spark, folder)
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in store.listStatus(p)] if store.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    store, p = _path(spark, path)
    store.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables below the shared folder. No result that still reads them may be used afterwards."""
    store, folder = _path(spark, shared_folder(spark))
    if store.exists(folder):
        for f in store.listStatus(folder):
            if f.getPath().getName().startswith("attestry-"):
                store.delete(f.getPath(), True)
