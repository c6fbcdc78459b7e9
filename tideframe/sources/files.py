"""Folders that the driver and all executors share, and listing files through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a temporary one, which only a local master can share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.mkdtemp(prefix='tideframe-')}/{name}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the work folder and read again: what follows does not redo them, nor depend on executors that may go."""
    path = work_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by ``settled`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._settled_path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where it is there already. One of several writers gets True."""
    return not exists(spark, path) and put_if_absent(spark, path, "")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file; folders above its new place are made."""
    fs, p = _file_system(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{old} could not be moved to {new}")


def set_modified(spark: SparkSession, path: str, at: int) -> None:
    """Give a file a modification time, in milliseconds since 1970."""
    fs, p = _file_system(spark, path)
    fs.setTimes(p, at, -1)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, of one copy."""
    fs, p = _file_system(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all where it is there already; of several writers one gets True.

    The text is written under another name first. A local file then gets its name
    by a hard link, any other by a rename that must not replace, which HDFS and
    stores with such a rename do in one step.
    """
    jvm = spark._jvm
    fs, p = _file_system(spark, path)
    p = fs.makeQualified(p)
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.resolvePath(draft).toUri().getScheme() == "file":
            place = jvm.java.io.File(fs.resolvePath(p.getParent()).toUri().getPath(), p.getName())
            jvm.java.nio.file.Files.createLink(place.toPath(), jvm.java.io.File(fs.resolvePath(draft).toUri().getPath()).toPath())
        else:
            kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            none = spark.sparkContext._gateway.new_array(kinds, 1)
            none[0] = kinds.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, p, none)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        fs.delete(draft, False)
