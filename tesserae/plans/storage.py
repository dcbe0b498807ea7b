"""Folders that every executor sees, tables written there to cut lineage, and the package itself for the workers."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a lost executor costs a read, not the work that led here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this plan are of no use once its result is in the shared folder
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that written() gave."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now
            return


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        for k in range(0, len(data), 1 << 22):
            out.write(bytearray(data[k : k + (1 << 22)]))
    finally:
        out.close()


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """A file in the shared folder, sent to every executor. SparkFiles.get() of the name returned here gives its place."""
    unique = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tesserae/files/{unique}"
    _put(spark, path, data)
    spark.sparkContext.addFile(path)
    return unique


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application; and bound what a batch of rows sent to them
    may have in bytes, where the session doesn't say it: rows of long texts would make batches of any size."""
    if _BATCH not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(_BATCH, "8m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    unique = f"tesserae-{uuid.uuid4().hex}.zip"
    path = f"{shared_dir(spark)}/tesserae/files/{unique}"
    _put(spark, path, out.getvalue())
    spark.sparkContext.addPyFile(path)
