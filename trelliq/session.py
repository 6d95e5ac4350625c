"""Session settings, and tables in the shared folder that cut lineage.

Which side of a join is broadcast is left to Spark: it measures a side (from its files, or its shuffle once that is
written) and shuffles it beyond the session's threshold. Operators ask for a broadcast of one-row aggregates only.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "trelliq", **conf: str) -> SparkSession:
    """A session with adaptive execution on; shuffle partitions follow the local cores unless given."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once: they need not find it by themselves."""
    context = spark.sparkContext
    if getattr(context, "_trelliq_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="trelliq-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "trelliq.zip", "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(folder / "trelliq.zip"))
    context._trelliq_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session's ``spark.checkpoint.dir``.

    Only a session in one process (``local``), such as that of a test, gets a temporary one where none is named; on a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="trelliq-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return checkpoint_dir(spark)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any scheme that the session's Hadoop settings know."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def store(uri: str):
    """(file system, path) of a place in the shared storage, for Python code that runs in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever storage it lies; nothing happens where there is none."""
    files, where = hadoop_path(spark, path)
    files.delete(where, True)


#: Tables of ``written`` that are still there, deleted when the process ends.
_tables: dict[str, SparkSession] = {}


def forget_tables() -> None:
    for path, spark in list(_tables.items()):
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already; the session's folder is then cleared by its owner
            pass
    _tables.clear()


atexit.register(forget_tables)


def new_place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the process ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def written(df: DataFrame, name: str = "cut", by: str | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later stages survive a lost executor.

    With ``by`` the table is cut into buckets by the hash of that column and sorted by it, so that joins and groupings by
    the column read it without a shuffle.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_place(spark, name)
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
        back._trelliq_table = path
        return back
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = f"trelliq_{uuid.uuid4().hex}"
    df.repartition(n, by).write.option("compression", "zstd").option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(named)
    back = spark.table(named)
    back._trelliq_table, back._trelliq_name = path, named
    return back


def discard(df: DataFrame) -> None:
    """Delete the table of ``written``; for one that a loop has replaced and no later result reads."""
    path = getattr(df, "_trelliq_table", None)
    if path:
        if name := getattr(df, "_trelliq_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        delete(df.sparkSession, path)
        _tables.pop(path, None)

