"""Sinks: create-only tables, artifacts as files."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create_table(records: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A new table; an existing one is an error."""
    w = records.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def append_new(records: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append records; one whose id is stored already, or stands twice in the batch, is an error and nothing is written."""
    ids = records.select("id")
    clash = ids.groupBy("id").count().where("count > 1").select("id")
    if exists(records.sparkSession, path):
        clash = clash.unionByName(ids.join(records.sparkSession.read.parquet(path).select("id"), "id", "left_semi"))
    if bad := clash.limit(3).collect():
        raise FileExistsError(f"records exist: {', '.join(str(r.id) for r in bad)}")
    w = records.write.mode("append").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_manifests(records: DataFrame, root: str, folder: Column) -> None:
    """One manifest.json a record under root/folder, two spaces of indent, absent fields left out; an existing one is an error."""

    def pretty(text: pd.Series) -> pd.Series:
        return text.map(lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False) + "\n")

    manifest = F.pandas_udf(pretty, "string")(F.to_json(F.struct("*")))
    write_files(records.select(F.concat_ws("/", folder, F.lit("manifest.json")).alias("path"), manifest.alias("contents")), root, create_only=True)


def inside_git_tree(path: str) -> bool:
    """Whether a library folder would lie in a Git working tree."""
    at = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return True
        if (up := os.path.dirname(at)) == at:
            return False
        at = up


def write_files(files: DataFrame, root: str, create_only: bool = False) -> None:
    """files(path, contents) as files under a shared folder, each by a temporary name and a rename; runs in the tasks.

    create_only: a file that is there with other contents is an error; one with the same contents stays, so that a task
    that is tried again meets what it wrote.
    """

    def put(rows):
        for r in rows:
            full, data = os.path.join(root, r.path), _bytes(r.contents)
            if create_only and os.path.exists(full):
                with open(full, "rb") as f:
                    if f.read() != data:
                        raise FileExistsError(f"file exists: {r.path}")
                continue
            _write_beside(full, data, "tmp")
            os.replace(f"{full}.tmp", full)

    files.select("path", "contents").foreachPartition(put)


def _bytes(contents) -> bytes:
    return contents.encode() if isinstance(contents, str) else bytes(contents)


def _write_beside(full: str, data: bytes, suffix: str) -> None:
    os.makedirs(os.path.dirname(full), exist_ok=True)
    part = f"{full}.{suffix}.{os.getpid()}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, f"{full}.{suffix}")


class VaultWrite:
    """Changed files of a vault, written in steps that can be undone: stage, apply, then commit or rollback.

    Staged files lie beside their places under a name of this write; what they replace is kept as a backup until commit().
    Every step runs in tasks and may be tried again. A file outside the vault, by .. or a link, is an error.
    """

    def __init__(self, files: DataFrame, root: str, name: str = "vault-write"):
        """files(path, contents): what vault.changes gives; root: a folder that all executors share."""
        self.files, self.root, self.name = files.select("path", "contents"), os.path.realpath(root), name

    def _each(self, step, contents: bool = False, check: bool = False) -> None:
        root, name = self.root, self.name

        def run(rows):
            for r in rows:
                full = os.path.join(root, r.path)
                inside = os.path.commonpath([root, os.path.realpath(full)]) == root and not os.path.isdir(full)
                if check and not inside:
                    raise ValueError(f"not a file of the vault: {r.path}")
                if inside:
                    step(full, f"{full}.{name}", r)

        (self.files if contents else self.files.select("path")).foreachPartition(run)

    def apply(self) -> VaultWrite:
        """Put all files in place; where one fails, everything is as it was before."""
        name = self.name

        def stage(full, staged, r):
            _write_beside(full, _bytes(r.contents), f"{name}.new")

        def place(full, staged, r):
            if not os.path.exists(f"{staged}.new"):
                return  # placed before this task was tried again
            if not os.path.exists(full):
                with open(f"{staged}.made", "wb"):
                    pass
            elif not os.path.exists(f"{staged}.bak") and not os.path.exists(f"{staged}.made"):
                os.link(full, f"{staged}.bak")
            os.replace(f"{staged}.new", full)

        self._each(lambda *_: None, check=True)
        try:
            self._each(stage, contents=True)
            self._each(place)
        except Exception:
            self.rollback()
            raise
        return self

    def commit(self) -> None:
        """Backups are removed: the write can no longer be undone."""

        def done(full, staged, r):
            for end in (".bak", ".new", ".made"):
                if os.path.exists(staged + end):
                    os.remove(staged + end)

        self._each(done)

    def rollback(self) -> None:
        """Replaced files come back, created ones go, others stay as they are."""

        def undo(full, staged, r):
            if os.path.exists(f"{staged}.bak"):
                os.replace(f"{staged}.bak", full)
            if os.path.exists(f"{staged}.made"):
                if os.path.exists(full):
                    os.remove(full)
                os.remove(f"{staged}.made")
            if os.path.exists(f"{staged}.new"):
                os.remove(f"{staged}.new")

        self._each(undo)
