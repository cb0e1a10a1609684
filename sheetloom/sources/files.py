"""Listing and deleting on whatever file system the cluster uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def list_entries(spark: SparkSession, folder: str) -> list[Entry]:
    """Visible entries of a folder, sorted by name."""
    fs, where = _file_system(spark, folder)
    found = [
        Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory())
        for s in fs.listStatus(where)
    ]
    return sorted((e for e in found if e.name[0] not in "._"), key=lambda e: e.name)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)
