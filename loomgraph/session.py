"""Session helpers: the shared folder, cutting lineage, sizing partitions."""

from __future__ import annotations

import atexit
import contextlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` of the session is used as it stands. Where it is
    unset, a temporary folder of this machine is set in local mode only: on a
    cluster every executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _at(spark: SparkSession, path: str):
    """File system and path of ``path``, whatever store it lies in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside and renames it, so that it is there whole or not at all."""
    fs, p = _at(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    fs.rename(part, p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _forget() -> None:
    while _WRITTEN:
        try:
            delete(*_WRITTEN.pop())
        except Exception:  # the session may have ended already
            pass


atexit.register(_forget)


@contextlib.contextmanager
def scope():
    """What is materialized within is deleted at the end: for steps whose result is written elsewhere."""
    mark = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > mark:
            delete(*_WRITTEN.pop())


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors: the written files
    belong to no executor. The schema is passed on, so that reading it back
    starts no job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a session, also where they share no folder with the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    place = f"{shared_dir(spark).rstrip('/')}/loomgraph/{app}/loomgraph.zip"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    _WRITTEN.append((spark, place))
    spark.sparkContext.addPyFile(place)
