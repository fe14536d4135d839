"""Tables that change by commits: files are never changed, and a version is a list of them that is published at once or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.session import settle, stored
from . import sinks

#: Versions between two full lists of files, so that a reader replays no more than these.
CHECKPOINT = 20


class Conflict(Exception):
    """Another writer has changed what this change was made from."""


class Log:
    """Numbered JSON entries in a folder. An entry is written under another name and renamed, which fails if its number is taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = settle(spark), path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def numbers(self) -> list[int]:
        """The versions, from the first."""
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict[str, Any]:
        stream = self._files.open(self._at(f"{number:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, entry: dict[str, Any]) -> bool:
        """Whether the entry is now the one of that number; False if another writer's is."""
        own = self._at(f".{uuid.uuid4().hex}.tmp")
        self._files.mkdirs(self._root)
        out = self._files.create(own, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self._context.rename(own, self._at(f"{number:010d}.json"), how)
            return True
        except Exception as e:
            self._files.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise


@dataclass(frozen=True)
class Snapshot:
    """version, files (name to rows, lo, hi of the key), schema, and the last batch of each writer that numbers its batches."""

    version: int
    files: dict[str, dict[str, Any]]
    schema: str | None
    batches: dict[str, int] = field(default_factory=dict)


class Table:
    """A table at path, found by key. Files are range-partitioned by key, so a change touches few, and only these are rewritten.

    Readers see one version, whole. A writer makes its files first and publishes the list last; if it dies before that, nothing has
    happened. If another writer came first, the change is published after it unless both touch a file or a key; then it is a Conflict.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key, self.log = settle(spark), path.rstrip("/"), key, Log(spark, f"{path.rstrip('/')}/_log")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The files of a version, the latest if none is named; -1 before the first."""
        numbers = [n for n in self.log.numbers() if version is None or n <= version]
        if version is not None and version not in numbers:
            raise ValueError(f"there is no version {version}")
        files: dict[str, dict[str, Any]] = {}
        batches: dict[str, int] = {}
        schema = None
        first = max((n for n in numbers if n % CHECKPOINT == 0), default=0)
        for n in numbers:
            if n < first:
                continue
            e = self.log.read(n)
            if e.get("all") is not None:
                files, batches = dict(e["all"]), dict(e["batches"])
            else:
                files = {k: v for k, v in files.items() if k not in e["remove"]} | e["add"]
                batches |= e["batch"]
            schema = e["schema"]
        return Snapshot(numbers[-1] if numbers else -1, files, schema, batches)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.snapshot(version))

    def _rows(self, s: Snapshot, names: list[str] | None = None) -> DataFrame:
        if s.schema is None:
            raise ValueError(f"there is no table at {self.path}")
        schema = StructType.fromJson(json.loads(s.schema))
        names = sorted(s.files) if names is None else names
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame, parts: int) -> dict[str, dict[str, Any]]:
        """New files of rows, with what is known of each."""
        folder = f"c-{uuid.uuid4().hex}"
        rows.repartitionByRange(max(1, parts), self.key).sortWithinPartitions(self.key).write.parquet(f"{self.path}/data/{folder}")
        made = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}")
        known = made.groupBy(_file().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).collect()  # a row for each new file
        return {r.f: {"rows": r.n, "lo": r.lo, "hi": r.hi} for r in known}

    def _commit(self, base: Snapshot, add: dict, remove: list[str], schema: str, keys: DataFrame | None, batch: dict[str, int] | None = None) -> int:
        version, mine = base.version + 1, {"add": add, "remove": remove, "schema": schema, "batch": batch or {}}
        while True:
            entry = dict(mine)
            if version % CHECKPOINT == 0 and version:
                before = self.snapshot(version - 1)
                entry |= {"all": {k: v for k, v in before.files.items() if k not in remove} | add, "batches": before.batches | mine["batch"]}
            if self.log.publish(version, entry):
                return version
            other = self.log.read(version)
            if batch and any(other["batch"].get(k, -1) >= v for k, v in batch.items()):
                return version  # this very batch is there already
            if set(other["remove"]) & set(remove) or (keys is not None and self._has(list(other["add"]), keys, base)):
                raise Conflict(f"version {version} has changed the same rows")
            version += 1

    def _has(self, names: list[str], keys: DataFrame, s: Snapshot) -> bool:
        return bool(names) and not self._rows(s, names).select(self.key).join(keys, self.key, "left_semi").isEmpty()

    def _touched(self, s: Snapshot, keys: DataFrame) -> list[str]:
        """Files that hold one of the keys: first by the ranges that the list has, then by their key columns alone."""
        span = keys.agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).first()
        near = [n for n, v in s.files.items() if span.lo is not None and (v["lo"] is None or (v["lo"] <= span.hi and v["hi"] >= span.lo))]
        if not near:
            return []
        found = self._rows(s, near).select(self.key, _file().alias("f")).join(keys, self.key, "left_semi")
        return sorted(r.f for r in found.select("f").distinct().collect())  # file names

    def create(self, rows: DataFrame, parts: int | None = None) -> int:
        """The first version, or one that replaces all rows."""
        s = self.snapshot()
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._commit(s, self._written(rows, n), list(s.files), rows.schema.json(), None)

    def _change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], base: Snapshot | None = None) -> int:
        s = base or self.snapshot()
        keys = stored(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "keys")
        touched = self._touched(s, keys)
        old = self._rows(s, touched)
        return self._commit(s, self._written(make(old).select(old.columns), len(touched)), touched, s.schema, keys)

    def upsert(self, fresh: DataFrame, base: Snapshot | None = None) -> int:
        """fresh rows in the place of those of their keys; the last of repeated keys (by all columns) counts, a null page becomes -1. Rows with a null key are added."""
        return self._change(fresh, lambda old: sinks.upserted(old.where(F.col(self.key).isNotNull()), fresh.where(F.col(self.key).isNotNull()), self.key).unionByName(fresh.where(F.col(self.key).isNull())).unionByName(old.where(F.col(self.key).isNull())), base)

    def delete(self, ids: DataFrame, base: Snapshot | None = None) -> int:
        """The table without the rows of the ids (key)."""
        return self._change(ids, lambda old: old.join(ids.select(self.key).distinct(), self.key, "left_anti"), base)

    def rebuild(self, fresh: DataFrame, ids: DataFrame, by: str = "doc_id", base: Snapshot | None = None) -> int:
        """All rows of the documents of ids replaced by fresh's rows of them, in one version."""
        s = base or self.snapshot()
        ids = ids.select(by).distinct()
        gone = self._rows(s).select(self.key, by).join(ids, by, "left_semi").select(self.key)
        new = fresh.join(ids, by, "left_semi")
        keys = gone.unionByName(new.select(self.key))
        return self._change(keys, lambda old: old.join(ids, by, "left_anti").unionByName(new), s)

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """rows added. A writer that numbers its batches adds each once: a batch that is there already, as after a restart, changes nothing."""
        s = self.snapshot()
        if writer is not None and s.batches.get(writer, -1) >= batch:
            return s.version
        return self._commit(s, self._written(rows, 1), [], s.schema or rows.schema.json(), None, {writer: batch} if writer is not None else None)

    def history(self) -> DataFrame:
        """version, files added and removed, rows added."""
        rows = [(n, len(e["add"]), len(e["remove"]), sum(v["rows"] for v in e["add"].values())) for n in self.log.numbers() for e in [self.log.read(n)]]
        return self.spark.createDataFrame(rows, "version int, added int, removed int, rows_added long")

    def vacuum(self, keep: int = 1) -> int:
        """Removes files that none of the last ``keep`` versions has; older versions can't be read then. Returns how many."""
        numbers = self.log.numbers()
        live = {f for n in numbers[-keep:] for f in self.snapshot(n).files}
        dead = {f for n in numbers for f in self.log.read(n)["add"]} - live
        gone = 0
        for name in dead:
            where = self.log._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}")
            gone += bool(self.log._files.delete(where, False))
        return gone


def _file() -> F.Column:
    """A row's file, as the list names it: its folder and its own name."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)


def audit_sink(table: Table, writer: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch becomes one commit with its number, so a batch replayed after a crash adds nothing."""

    def put(rows: DataFrame, batch: int) -> None:
        table.append(rows, writer, batch)

    return put
