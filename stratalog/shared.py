"""Tables that outlive a stage: written to the folder all executors share.

The cluster names that folder in ``spark.checkpoint.dir``. Only where the
setting is missing (local tests) is a temporary folder of this machine used.
A written parquet table cuts lineage, survives the loss of executors and is
smaller than the row format of a checkpoint.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; one of our own only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="stratalog-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_local[app]}")
    return f"file://{_local[app]}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`written` made in this process, once their readers are done; how many there were."""
    for at in _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    n = len(_written)
    _written.clear()
    return n


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def state_of(spark: SparkSession, path: str) -> str:
    """Length and time of change of all files at a path: equal as long as nothing was written there."""
    at, fs = _fs(spark, path)
    own = fs.getFileStatus(at)
    files = [own] if own.isFile() else fs.listStatus(at)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is no such file."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Publishes a small file whole or not at all; without ``replace`` False, and nothing written, if the file exists."""
    jvm, (at, fs) = spark._jvm, _fs(spark, path)
    if not replace and fs.exists(at):
        return False
    new, _ = _fs(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration()).rename(new.makeQualified(fs.getUri(), fs.getWorkingDirectory()), at.makeQualified(fs.getUri(), fs.getWorkingDirectory()), options)
    except Exception as e:
        fs.delete(new, False)
        if not replace and "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)
