"""Versioned tables in a shared folder: parts are written first, a manifest that names them is put in place last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Versions:
    """Named tables of a folder, each a list of parts. Readers see whole commits only.

    ``put`` writes a part that doesn't count yet; ``commit`` writes the next manifest, by one rename. A part that a
    commit replaces is deleted by the commit after next, so readers of the version before may end their work. A new
    object on the same folder goes on where the last commit stopped; parts of a run that died are never read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._path("")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self.number = max((int(n[9:-5]) for n in self._names() if n.startswith("manifest-")), default=0)
        self._now = json.loads(self._text(f"manifest-{self.number:012d}.json")) if self.number else {"tables": {}, "values": {}, "retired": []}
        self._next: dict[str, list[str]] = {}
        self._schemas: dict[str, str] = {}

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @property
    def values(self) -> dict:
        """What the last commit kept besides tables."""
        return self._now["values"]

    def parts(self, name: str) -> list[str]:
        return self._now["tables"].get(name, {}).get("parts", [])

    def table(self, name: str) -> DataFrame | None:
        """The table as of the last commit, None before its first part."""
        held = self._now["tables"].get(name)
        if not held or not held["parts"]:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(*(f"{self.folder}/{p}" for p in held["parts"]))

    def put(self, name: str, df: DataFrame, replace: bool = False, **options: object) -> DataFrame:
        """Writes a part of a table, to be added to its parts or to replace them all; returns the part as written."""
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(f"{self.folder}/{part}")
        self._next[name] = [*([] if replace else self._next.get(name, self.parts(name))), part]
        self._schemas[name] = df.schema.json()
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{part}")

    def commit(self, **values: object) -> int:
        """Makes all that was put since the last commit the newest version; returns its number."""
        tables = dict(self._now["tables"])
        for name, parts in self._next.items():
            tables[name] = {"parts": parts, "schema": self._schemas[name]}
        kept = {p for t in tables.values() for p in t["parts"]}
        retired = [p for t in self._now["tables"].values() for p in t["parts"] if p not in kept]
        state = {"tables": tables, "values": {**self.values, **values}, "retired": retired}
        number = self.number + 1
        name, waiting = f"manifest-{number:012d}.json", f".manifest-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(waiting), True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(waiting), self._path(name)):
            self._fs.delete(self._path(waiting), False)
            raise RuntimeError(f"version {number} of {self.folder} was committed by another writer")
        for part in self._now["retired"]:
            self._fs.delete(self._path(part), True)
        if self.number:
            self._fs.delete(self._path(f"manifest-{self.number - 1:012d}.json"), False)
        self.number, self._now, self._next, self._schemas = number, state, {}, {}
        return number

    def reset(self, **tables: DataFrame) -> int:
        """Replaces tables by their seeds in one commit."""
        for name, seed in tables.items():
            self.put(name, seed, replace=True)
        return self.commit()
