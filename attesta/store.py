"""Versioned table snapshots on any Hadoop file system: all touched tables are written, then one pointer file appears.

Pointers are numbered and never replaced: a commit renames its own into place
under the next number, which fails if another writer took that number, so a
reader sees the tables of one version or of the next, never a mixture or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from attesta.schemas import TABLES


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str | None:
        at = self._path(path)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.base}/versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _publish(self, version: int, text: str) -> None:
        """Make ``text`` the pointer of ``version``; an error if that version exists."""
        fresh, final = self._path(f"{self.base}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.base}/versions/{version:012d}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(final), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(fresh, False)
            raise OSError(f"another writer committed version {version}") from e

    def pointer(self) -> dict[str, str]:
        return self._at()[1]

    def _at(self) -> tuple[int, dict[str, str]]:
        """The newest version and its tables."""
        versions = self._versions()
        return (versions[-1], json.loads(self._read(f"{self.base}/versions/{versions[-1]:012d}"))) if versions else (0, {})

    def apply_schema(self) -> list[str]:
        """Create the tables that are missing, empty; returns their names."""
        missing = [t for t in TABLES if t not in self.pointer()]
        self.commit({t: self.spark.createDataFrame([], TABLES[t]) for t in missing})
        return missing

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.base}/{self.pointer()[name]}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write the next snapshot of every table, then let all of them count at once."""
        if not tables:
            return
        version, before = self._at()
        moved = {}
        for name, df in tables.items():
            where = f"{name}/{uuid.uuid4().hex}"
            df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name]]).write.parquet(f"{self.base}/{where}")
            moved[name] = where
        self._publish(version + 1, json.dumps(before | moved, sort_keys=True))

    def append(self, name: str, rows: DataFrame) -> None:
        self.commit({name: self.table(name).unionByName(rows.select(*[f.name for f in TABLES[name]]))})

    def preflight(self) -> list[str]:
        """What is wrong with the store: missing tables, unreadable ones, other schemas."""
        found, wrong = self.pointer(), []
        for name, schema in TABLES.items():
            if name not in found:
                wrong.append(f"table {name} is missing")
                continue
            have = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.base}/{found[name]}").schema}
            want = {f.name: f.dataType.simpleString() for f in schema}
            if have != want:
                wrong.append(f"table {name} has another schema")
        return wrong

    def reset(self, yes: bool = False) -> dict[str, int]:
        """Drop all tables; refused without ``yes``. Returns the rows that went."""
        if not yes:
            raise ValueError("reset needs --yes")
        counts = {name: self.table(name).count() for name in self.pointer() if name in TABLES}
        self._fs.delete(self._path(self.base), True)
        return counts


def append_rejected(records: DataFrame, path: str) -> None:
    """Rejected records as JSON lines."""
    records.write.mode("append").json(path)
