"""Stored tables that change by commits: several tables at once, or none of them.

Rows lie in Parquet folders that are never changed. A commit is one small file, numbered, that names the folders of every table; the
highest number is what readers see. A writer writes its folders first and then creates the file of the next number, which fails if
it is there: of two writers that started from one version the second gets ``Conflict`` and can start anew. A writer that
dies leaves folders that no commit names. Each commit also holds, by run, the newest batch that it includes, so that a run, or
a stream's batch, that comes again changes nothing.

A table is dealt into partitions by a column, or is one partition. ``merge`` reads and rewrites the partitions that the new keys
touch and no others. Which folders there are and which partitions are touched comes to the driver: a row a partition.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import tables
from shoal.sources import schemas

PART = "_part"


class Conflict(RuntimeError):
    """Another writer was first."""


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + os.path.join(tempfile.gettempdir(), "shoal-tables")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what several parts of a query read is worked out once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _part(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


@dataclass
class Snapshot:
    version: int = 0
    runs: dict[str, int] = field(default_factory=dict)
    #: table -> partition -> folders
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)


@dataclass
class Change:
    """rows to ``append`` to a table, to put in its place (``replace``), or to merge by the table's keys: ``merge`` whole rows, ``fill`` only
    values that aren't null, ``insert`` only keys that aren't held, ``swap`` whole partitions that they name."""

    table: str
    rows: DataFrame
    how: str = "append"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def head(self) -> Snapshot:
        """The newest version; 0 where nothing was committed."""
        if not self.files.exists(self._path("commits")):
            return Snapshot()
        numbers = [int(s.getPath().getName()[:-5]) for s in self.files.listStatus(self._path("commits")) if s.getPath().getName().endswith(".json")]
        return self.at(max(numbers)) if numbers else Snapshot()

    def at(self, version: int) -> Snapshot:
        if not version:
            return Snapshot()
        stream = self.files.open(self._path(f"commits/{version:010}.json"))
        try:
            return Snapshot(version, **json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, snapshot: Snapshot) -> None:
        """Write the commit aside and give it its name, which only one writer can."""
        draft, name = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"commits/{snapshot.version:010}.json")
        self.files.mkdirs(name.getParent())
        out = self.files.create(draft, False)
        out.write(json.dumps({"runs": snapshot.runs, "tables": snapshot.tables}).encode())
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        never[0] = getattr(jvm, "Options$Rename").NONE
        context = jvm.FileContext.getFileContext(self.files.makeQualified(name).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, name, never)
        except Exception as e:
            self.files.delete(draft, False)
            if self.files.exists(name):
                raise Conflict(f"version {snapshot.version} is taken") from e
            raise

    def read(self, name: str, parts: Iterable[str] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """A table as of the newest or another version; of some of its partitions, if told."""
        t, held = schemas.table(name), (snapshot or self.head()).tables.get(name, {})
        folders = [f"{self.root}/{f}" for p, fs in sorted(held.items()) if parts is None or p in parts for f in fs]
        schema = t.columns
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame) -> tuple[str, list[str]]:
        """The folder that rows were written to, and the partitions in it."""
        t = schemas.table(name)
        folder = f"data/{name}/{uuid.uuid4().hex}"
        wanted = self.spark.createDataFrame([], t.columns).schema
        have = set(rows.columns)
        x = rows.select(*((F.col(c.name) if c.name in have else F.lit(None)).cast(c.dataType).alias(c.name) for c in wanted))
        if t.part is None:
            x.write.parquet(f"{self.root}/{folder}")
            return folder, [""]
        x.withColumn(PART, _part(t.part)).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.root}/{folder}")
        return folder, [s.getPath().getName()[len(PART) + 1 :] for s in self.files.listStatus(self._path(folder)) if s.isDirectory()]

    def _apply(self, change: Change, snapshot: Snapshot) -> None:
        t, held = schemas.table(change.table), dict(snapshot.tables.get(change.table, {}))
        rows, touched = change.rows, None
        if change.how in ("merge", "fill", "insert"):
            if t.part is not None:
                touched = [r[0] for r in rows.select(_part(t.part)).distinct().collect()]
            old = self.read(change.table, touched, snapshot)
            rows = tables.upsert(old, rows, list(t.keys), {"merge": "replace", "fill": "coalesce", "insert": "insert"}[change.how])
        folder, parts = self._write(change.table, rows)
        where = {p: f"{folder}/{PART}={p}" if t.part else folder for p in parts}
        if change.how == "append":
            held = held | {p: [*held.get(p, []), f] for p, f in where.items()}
        elif change.how == "replace":
            held = {p: [f] for p, f in where.items()}
        else:
            held = held | {p: [f] for p, f in where.items()}
        snapshot.tables = snapshot.tables | {change.table: held}

    def commit(self, run: str, changes: list[Change], batch: int = 0, base: int | None = None) -> int:
        """The version that holds the changes. ``base``: the version that they were made from, by default the newest; Conflict if there is a later one.

        Nothing happens if ``run`` has committed this batch or a later one. Merges see the changes before them.
        """
        found = self.head()
        if found.runs.get(run, -1) >= batch:
            return found.version
        if base is not None and base != found.version:
            raise Conflict(f"version {base} was followed by {found.version}")
        new = Snapshot(found.version + 1, found.runs | {run: batch}, dict(found.tables))
        for c in changes:
            self._apply(c, new)
        self._publish(new)
        return new.version
