"""A result table that grows by commits (K2).

``<path>/data/<name>-<id>`` holds the files of one commit, ``<path>/commits/<name>.json``
names them with their number of rows. The commit file is written under another
name and renamed last; readers read the files that commits name and nothing
else. So a crash, a job's markers or a second attempt never add or hide rows:
what an unfinished commit left behind is no part of the table.

One writer at a time; a name is committed once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from voxpop.session import path_exists


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a table: name, folder, files, rows."""
    names = [n for n in _names(spark, f"{path}/commits") if n.endswith(".json") and not n.startswith(".")]
    out = []
    for name in names:
        fs, p = _fs(spark, f"{path}/commits/{name}")
        stream = fs.open(p)
        try:
            out.append(json.loads(bytes(stream.readAllBytes()).decode("utf-8")))
        finally:
            stream.close()
    return out


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows, None before the first commit. Data without a commit log is an error: its rows cannot be told from leftovers."""
    found = commits(spark, path)
    if not found:
        if any(n.endswith(".parquet") for n in _names(spark, path)):
            raise ValueError(f"{path} holds data but no commits")
        return None
    return spark.read.parquet(*[f"{path}/data/{c['folder']}/{f}" for c in found for f in c["files"]])


def commit(df: DataFrame, path: str, name: str) -> dict:
    """Write ``df`` and commit it under ``name``; a name that is committed already is an error, before anything is written."""
    spark = df.sparkSession
    if path_exists(spark, f"{path}/commits/{name}.json"):
        raise ValueError(f"{name} is committed already")
    folder = f"{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/data/{folder}")
    files = [n for n in _names(spark, f"{path}/data/{folder}") if n.endswith(".parquet")]
    entry = {"name": name, "folder": folder, "files": files, "rows": spark.read.schema(df.schema).parquet(f"{path}/data/{folder}").count()}
    fs, draft = _fs(spark, f"{path}/commits/.{folder}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(entry).encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(draft, _fs(spark, f"{path}/commits/{name}.json")[1]):
        raise RuntimeError(f"{name} could not be committed")
    return entry


def drop_uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that no commit names, left by crashes; only while no writer runs."""
    kept = {c["folder"] for c in commits(spark, path)}
    stale = [n for n in _names(spark, f"{path}/data") if n not in kept]
    for name in stale:
        fs, p = _fs(spark, f"{path}/data/{name}")
        fs.delete(p, True)
    return stale
