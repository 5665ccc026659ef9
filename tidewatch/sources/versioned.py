"""Parquet tables with a commit log: appends, upserts and compactions that readers see whole or not at all.

Data files are never changed. A write puts its rows into new folders, one for each partition, and then one commit file
names, for each partition, the folders that make it up now. A reader takes the newest commit, so a write that dies before its
commit leaves folders that nothing names; ``vacuum`` removes those and the ones of old versions. A commit file is created
only where none is, so of two writers of one version the second fails. Writes of a stream carry the name of the stream and
the number of the batch, which the log remembers: a batch that runs again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.sinks import upsert

_VERSION = "__version"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: list[str]):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        log = self._at("_commits")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(log)) if self._fs.exists(log) else []

    def state(self, version: int | None = None) -> dict:
        """version, schema, batches (last number by stream) and parts (folders by partition); version -1 is the empty table."""
        found = self.versions()
        if not found:
            return {"version": -1, "schema": None, "batches": {}, "parts": {}}
        stream = self._fs.open(self._at(f"_commits/{found[-1] if version is None else version:020d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _committed(self, state: dict, schema: T.StructType, parts: dict, stream: str | None, batch: int | None) -> None:
        record = {"version": state["version"] + 1, "schema": schema.json(), "parts": parts, "batches": state["batches"] | ({stream: batch} if stream is not None else {})}
        out = self._fs.create(self._at(f"_commits/{record['version']:020d}"), False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()

    def _known(self, state: dict, stream: str | None, batch: int | None) -> bool:
        return stream is not None and state["batches"].get(stream, -1) >= batch

    def staged(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write ``rows`` to new folders, which nothing names yet: the folders by partition."""
        name = uuid.uuid4().hex
        rows.withColumn(_VERSION, F.lit(name)).write.mode("append").partitionBy(*self.partition_by, _VERSION).parquet(f"{self.path}/data")
        found = self._fs.globStatus(self._at("data/" + "*/" * len(self.partition_by) + f"{_VERSION}={name}")) or []
        root = self._fs.makeQualified(self._at("data")).toUri().getPath()
        return {f.getPath().getParent().toUri().getPath()[len(root) + 1 :]: [name] for f in found}

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None for a table without a commit."""
        state = self.state(version)
        return self._rows(state, state["parts"]) if state["schema"] else None

    def _rows(self, state: dict, parts: dict[str, list[str]]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/data/{part}/{_VERSION}={v}" for part, vs in parts.items() for v in vs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField(_VERSION, T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """False if the log has the batch already."""
        state = self.state()
        if self._known(state, stream, batch):
            return False
        parts = dict(state["parts"])
        for part, vs in self.staged(rows).items():
            parts[part] = parts.get(part, []) + vs
        self._committed(state, rows.schema, parts, stream, batch)
        return True

    def upsert(self, rows: DataFrame, keys: list[str], update_cols: list[str], stream: str | None = None, batch: int | None = None) -> bool:
        """``sinks.upsert`` into the partitions that ``rows`` touch; the others' folders stay in the table as they are.

        ``keys`` hold the partition columns, so a row never moves to another partition.
        """
        if missing := [c for c in self.partition_by if c not in keys]:
            raise ValueError(f"keys lack the partition columns {missing}")
        state = self.state()
        if self._known(state, stream, batch):
            return False
        parts = dict(state["parts"])
        if state["schema"]:
            old = self._rows(state, parts)
            touched = [tuple(r) for r in rows.select(*self.partition_by).distinct().collect()] if self.partition_by else []
            near = F.lit(not self.partition_by)
            for values in touched:
                same = F.lit(True)
                for c, v in zip(self.partition_by, values):
                    same = same & F.col(c).eqNullSafe(F.lit(v))
                near = near | same
            new = upsert(old.filter(near), rows, keys, update_cols).select(*old.columns)
        else:
            new = rows
        parts |= self.staged(new)
        self._committed(state, new.schema, parts, stream, batch)
        return True

    def compact(self, least: int = 2) -> int:
        """Partitions of at least ``least`` folders become one folder each; how many did."""
        state = self.state()
        many = {part: vs for part, vs in state["parts"].items() if len(vs) >= least}
        if many:
            rows = self._rows(state, many)
            even = rows.repartition(*self.partition_by) if self.partition_by else rows.coalesce(1)
            self._committed(state, rows.schema, state["parts"] | self.staged(even), None, None)
        return len(many)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions names, and older commits; how many folders went. Not to
        be run beside a writer, whose folders no version names yet."""
        found = self.versions()
        named = {f"{part}/{_VERSION}={v}" for n in found[-keep:] for part, vs in self.state(n)["parts"].items() for v in vs}
        root = self._fs.makeQualified(self._at("data")).toUri().getPath()
        gone = 0
        for f in self._fs.globStatus(self._at("data/" + "*/" * len(self.partition_by) + f"{_VERSION}=*")) or []:
            if f.getPath().toUri().getPath()[len(root) + 1 :] not in named:
                self._fs.delete(f.getPath(), True)
                gone += 1
        for n in found[:-keep]:
            self._fs.delete(self._at(f"_commits/{n:020d}"), False)
        return gone
