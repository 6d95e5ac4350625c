"""Writers of tables, reports and manifests."""

from __future__ import annotations

import hashlib
import json
import subprocess
from dataclasses import asdict, is_dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trelliq.session import hadoop_path, store

#: Files up to this size are hashed as a whole, larger ones by size, first and last chunk.
WHOLE_HASH = 512 << 20
CHUNK = 8 << 20


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, in folders by a column (such as the split) when given, so that a filter on it prunes."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def jsonl(df: DataFrame, path: str, order: str = "query_id", files: int | None = None) -> None:
    """JSON lines in the order of a column, fields in the frame's order, nulls kept: the same rows give the same bytes.

    Sorting is a range partitioning, so a large table becomes several files in order; ``files=1`` makes one.
    """
    ordered = df.coalesce(1).sortWithinPartitions(order) if files == 1 else df.orderBy(order)
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def plain(value):
    """A value as JSON knows it: sets sorted, paths and times as text, records as objects."""
    if is_dataclass(value):
        return plain(asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value), key=str)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def placed(path: str):
    """(file system, path) of a place on any storage that the session knows, its default one where the path names none."""
    files, where = hadoop_path(SparkSession.active(), path)
    return store(files.makeQualified(where).toString())


def write_text(path: str, text: str) -> None:
    files, where = placed(path)
    files.create_dir(where.rpartition("/")[0])
    with files.open_output_stream(where) as out:
        out.write(text.encode())


def report(values: dict, path: str) -> None:
    """A small report; frames in it are aggregates of a few rows and are collected."""
    rows = {k: [r.asDict(True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in values.items()}
    write_text(path, json.dumps(plain(rows), indent=2, ensure_ascii=False) + "\n")


def file_hash(files, info) -> str:
    h = hashlib.sha256()
    with files.open_input_file(info.path) as f:
        if info.size <= WHOLE_HASH:
            while block := f.read(CHUNK):
                h.update(block)
        else:
            h.update(str(info.size).encode() + f.read(CHUNK))
            f.seek(info.size - CHUNK)
            h.update(f.read(CHUNK))
    return h.hexdigest()


def path_hash(path: str) -> str | None:
    """SHA-256 of a file, of the sorted (name, hash) pairs of a folder, or None where nothing is; on any storage."""
    from pyarrow import fs

    files, where = placed(path)
    info = files.get_file_info(where)
    if info.type == fs.FileType.Directory:
        inside = [x for x in files.get_file_info(fs.FileSelector(where, recursive=True)) if x.type == fs.FileType.File]
        parts = sorted((x.path[len(where) :].lstrip("/"), file_hash(files, x)) for x in inside)
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()
    return file_hash(files, info) if info.type == fs.FileType.File else None


def revision(folder: str) -> str:
    """The commit of the working copy in a folder, or "unknown" where there is none or it cannot be read."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def manifest(path: str, phase: str, seed: int, settings, inputs: list[str], outputs: list[str], version: str | None = None) -> dict:
    """Write and return what a phase read and made, with the time in UTC and the revision of this code."""
    made = {"phase": phase, "at": datetime.now(timezone.utc).isoformat(), "revision": version or revision(str(Path(__file__).parent)), "seed": seed, "settings": plain(settings),
            "inputs": {p: path_hash(p) for p in inputs}, "outputs": {p: path_hash(p) for p in outputs}}
    write_text(path, json.dumps(made, indent=2) + "\n")
    return made


def set_readonly(path: str, readonly: bool = True) -> None:
    """Take away or give back the right to write a file or everything in a folder, on any storage."""
    spark = SparkSession.active()
    files, where = hadoop_path(spark, path)
    write = 0o222

    def change(at) -> None:
        info = files.getFileStatus(at)
        mode = info.getPermission().toShort()
        if info.isDirectory():
            if not readonly:
                files.setPermission(at, spark._jvm.org.apache.hadoop.fs.permission.FsPermission(f"{mode | 0o200:o}"))
            for x in files.listStatus(at):
                change(x.getPath())
        files.setPermission(at, spark._jvm.org.apache.hadoop.fs.permission.FsPermission(f"{(mode & ~write) if readonly else (mode | 0o200):o}"))

    change(where)


def cached_vectors(texts: DataFrame, folder: str, model: str, encode) -> DataFrame:
    """(key, text, embedding) for each distinct text of ``texts`` (one column, text).

    Vectors lie in a table by model, keyed by the digest of the text; only texts that it lacks are encoded and added.
    ``encode`` maps a frame (key, text) to (key, embedding).
    """
    from pyspark.sql import functions as F

    spark: SparkSession = texts.sparkSession
    place = f"{folder}/{model}"
    wanted = texts.filter("text IS NOT NULL").distinct().select(F.sha2("text", 256).alias("key"), "text")
    schema = "key string, embedding array<float>"
    files, where = hadoop_path(spark, place)
    known = spark.read.schema(schema).parquet(place) if files.exists(where) else spark.createDataFrame([], schema)
    missing = wanted.join(known.select("key"), "key", "left_anti")
    encode(missing).select("key", F.col("embedding").cast("array<float>")).write.mode("append").parquet(place)
    return wanted.join(spark.read.schema(schema).parquet(place), "key")
