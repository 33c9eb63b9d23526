"""Versioned tables: readers see whole commits only, writers add one or start over.

A commit is a small file that maps table names to Parquet folders.  Data is written first, to folders
of its own; the commit file is written aside and renamed to the next number, which fails if another
writer was faster.  A job that dies before the rename leaves folders that nothing refers to, and
``vacuum`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIES = 10


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit builds on."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        top = self._path("")
        self._fs = top.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(top).toUri(), conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._listed("commits") if n.isdigit())

    def version(self) -> int:
        """The last commit; 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Table name to folder, relative to the root."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{version:012d}", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        folder = self.manifest(version).get(name)
        return None if folder is None else self.spark.read.parquet(f"{self.root}/{folder}")

    def new_folder(self) -> str:
        """A folder for data that a later commit will refer to, relative to the root."""
        return f"data/{uuid.uuid4().hex}"

    def commit(self, tables: Mapping[str, DataFrame], base: int | None = None) -> int:
        """Write ``tables`` beside the other tables of version ``base`` and make them the next version."""
        base = self.version() if base is None else base
        folder, manifest = self.new_folder(), self.manifest(base)
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/{folder}/{name}")
            manifest[name] = f"{folder}/{name}"
        self._publish(base + 1, manifest)
        return base + 1

    def _publish(self, version: int, manifest: Mapping[str, str]) -> None:
        aside = self._path(f"commits/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._context.rename(aside, self._path(f"commits/{version:012d}"), options)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.toString():
                raise Conflict(f"version {version} of {self.root} exists") from None
            raise

    def merge(
        self, name: str, rows: DataFrame, keys: Sequence[str], others: Mapping[str, DataFrame] | None = None
    ) -> int:
        """Commit the table with ``rows`` in the place of those with equal keys; the same rows again change nothing.

        Null keys equal each other.  ``rows`` has one row per key and is computed again if another writer comes
        first.  ``others`` are tables to replace in the same commit.
        """
        for _ in range(RETRIES):
            base = self.version()
            old = self.read(name, base)
            merged = rows
            if old is not None:
                new = rows.select(*[F.col(k).alias(f"__{k}") for k in keys])
                match = [old[k].eqNullSafe(new[f"__{k}"]) for k in keys]
                merged = old.join(new, match, "left_anti").unionByName(rows, allowMissingColumns=True)
            try:
                return self.commit({**(others or {}), name: merged}, base)
            except Conflict:
                continue
        raise Conflict(f"{RETRIES} writers were faster")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` commits and the folders that none of those refers to.

        Not to be run while a writer is at work: its folders are not referred to yet.
        """
        versions = self.versions()
        used = {folder.split("/")[1] for v in versions[-keep:] for folder in self._folders(v)}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"commits/{v:012d}"), False)
        gone = [f for f in self._listed("data") if f not in used]
        for f in gone:
            self._fs.delete(self._path(f"data/{f}"), True)
        return gone

    def _folders(self, version: int) -> list[str]:
        return list(self.manifest(version).values())
