"""Folders that all executors share, for streams and for what operators read twice.

Executors may be lost and do not share folders with the driver, so what is read twice is
written as Parquet below ``spark.checkpoint.dir``. An application's folder goes with it.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="loom-code-")) / "sparkloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder (as a URI) below the cluster's shared checkpoint folder.

    A folder of this machine is used only when the setting is absent, which is
    accepted in local mode alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            root = kept
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = Path(tempfile.mkdtemp(prefix="loom-shared-")).as_uri()
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if "://" not in root and not root.startswith("file:"):
        root = Path(root).as_uri() if root.startswith("/") else root
    own = f"{root.rstrip('/')}/loom-{spark.sparkContext.applicationId}"
    if own not in _MARKED:  # the application's folder goes when its JVM ends
        fs, path = _hadoop(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/cut"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` wrote. Only for those whose every reader has been written itself."""
    for df in cuts:
        fs, path = _hadoop(df.sparkSession, df._cut_path)
        fs.delete(path, True)


#: Rows of a table that one task takes, where a session's rows grow to many times their bytes in a file.
TASK_ROWS = 1 << 16


def spread(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, a table as read, dealt by ``keys`` over tasks of about ``task_rows`` rows.

    Files are small beside the rows made of them, so neither their bytes nor those of a shuffle tell how
    many tasks these rows need. Windows, groups and joins by the keys keep this dealing."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-rows // task_rows), min(cores, -(-8 * rows // task_rows)), 1)
    return df.repartition(tasks, *keys)


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _hadoop(spark, uri)
    return fs.exists(path)


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _hadoop(spark, uri)
    fs.delete(path, True)


def subfolders(spark: SparkSession, uri: str) -> list[int]:
    """The numbers that name folders below ``uri``, in order."""
    fs, path = _hadoop(spark, uri)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())
