"""A versioned store of the graph's tables: commits add small Parquet folders and then one small manifest.

A table is a list of parts in order. A part has rows and the keys (``schemas.KEYS``) that it replaces or removes in the parts
before it, so a change costs its own size; readers leave out rows whose key a later part names. A table of ``MOST_PARTS``
parts is written whole at its next change. Readers see the state of one manifest, and an operation that pins one reads all
its tables from it. There is one writer at a time: it holds a lock file, others wait for it; and a manifest's name is its
number, which the file system creates for one writer only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.quantised import laid_out
from .schemas import KEYS, SUMMED, VERSION, migrated, schema

#: Parts of a table; the next one makes it whole.
MOST_PARTS = 8
#: Tables that a commit writes at once.
WRITERS = 4
#: Seconds after which a lock of a writer that died is taken over.
LEASE = 3600
#: Keys of parts up to this many are broadcast to the rows.
BROADCAST_KEYS = 1 << 20

#: In place of keys: the rows are added to those that are there.
ADDED = "added"
#: Rows to put in (or none), and the keys (key) that they replace or that go (none: the rows are the whole table).
Change = tuple[DataFrame | None, DataFrame | str | None]


class Conflict(RuntimeError):
    """Another writer committed first, or holds the lock for too long."""


class Store:
    def __init__(self, spark: SparkSession, path: str, timeout: float = 300.0):
        self.spark, self.path, self.timeout, self._pin, self._locked = spark, path.rstrip("/"), timeout, None, 0
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifests"))

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self.path}/manifests")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._Path(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; false if it is."""
        try:
            stream = self._fs.create(self._Path(f"{self.path}/{name}"), False)
        except Py4JJavaError:
            if self._fs.exists(self._Path(f"{self.path}/{name}")):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def manifest(self) -> dict:
        """The pinned or the latest manifest: number, schema version, parts of tables by name, meta values."""
        if self._pin is not None:
            return self._pin
        for number in reversed(self._numbers()):
            try:
                return json.loads(self._read(f"manifests/{number}.json"))
            except json.JSONDecodeError:  # one that is just being written
                continue
        return {"number": 0, "version": VERSION, "tables": {}, "meta": {"write_epoch": 0, "indexed_epoch": 0}}

    @contextmanager
    def pinned(self) -> Iterator[dict]:
        """Read all tables from one manifest."""
        before = self._pin
        self._pin = self.manifest()
        try:
            yield self._pin
        finally:
            self._pin = before

    @contextmanager
    def writing(self) -> Iterator[None]:
        """Hold the writer's lock; wait for it up to ``timeout`` seconds."""
        if self._locked:
            self._locked += 1
        else:
            until = time.monotonic() + self.timeout
            while not self._create("lock", json.dumps({"since": time.time()})):
                try:
                    since = json.loads(self._read("lock"))["since"]
                except (Py4JJavaError, json.JSONDecodeError):  # gone or just being written
                    since = time.time()
                if time.time() - since > LEASE:
                    self._fs.delete(self._Path(f"{self.path}/lock"), False)
                elif time.monotonic() >= until:
                    raise Conflict("another writer is at work")
                else:
                    time.sleep(min(0.2, max(0.0, until - time.monotonic())))
            self._locked = 1
        try:
            yield
        finally:
            self._locked -= 1
            if not self._locked:
                self._fs.delete(self._Path(f"{self.path}/lock"), False)

    def table(self, name: str) -> DataFrame:
        """A table in today's layout, empty if it was never written."""
        return self._merged(name, self.manifest()["tables"].get(name, []))

    def empty(self, name: str) -> DataFrame:
        """A table without rows."""
        return self.spark.createDataFrame([], schema(name))

    @staticmethod
    def _part(rows: str | None, gone: str | None = None, n_gone: int = 0) -> dict:
        return {"rows": rows, "gone": gone, "n_gone": n_gone, "version": VERSION}

    def _merged(self, name: str, parts: list[dict]) -> DataFrame:
        rows, gone, n_gone = None, None, 0
        for k, part in enumerate(parts):
            if part["rows"]:
                here = migrated(self.spark.read.parquet(f"{self.path}/{part['rows']}"), name, part["version"]).withColumn("__part", F.lit(k))
                rows = here if rows is None else rows.unionByName(here)
            if part["gone"] and k:
                keys = self.spark.read.schema("key string").parquet(f"{self.path}/{part['gone']}").select("key", F.lit(k).alias("__last"))
                gone, n_gone = keys if gone is None else gone.union(keys), n_gone + part["n_gone"]
        if rows is None:
            return self.empty(name)
        if name in SUMMED:
            names = [c for c in schema(name).names if c != "n"]
            return rows.select(*names, "n") if len(parts) == 1 else rows.groupBy(*names).agg(F.sum("n").alias("n")).filter("n <> 0")
        if gone is not None:
            last = gone.groupBy("key").agg(F.max("__last").alias("__last"))
            last = F.broadcast(last) if n_gone <= BROADCAST_KEYS else last
            rows = rows.withColumn("__key", F.expr(KEYS[name]))
            rows = rows.join(last, (F.col("__key") == F.col("key")) & (F.col("__part") < F.col("__last")), "left_anti")
        return rows.select(*schema(name).names)

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"tables/{name}-{uuid.uuid4().hex}"
        # columns that the rows lack are null
        rows = rows.select(*(f.name if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)))
        if name.endswith("_posting"):  # sorted, a term's entries lie in few pages of each file, and the others are skipped
            rows = rows.sortWithinPartitions("term")
        elif name in SUMMED:
            rows = rows.repartitionByRange(schema(name).names[0]).sortWithinPartitions(schema(name).names[0])
        writer = laid_out(rows) if name.endswith("_cell") else rows.write
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def _write_keys(self, gone: DataFrame) -> tuple[str, int]:
        folder = f"tables/keys-{uuid.uuid4().hex}"
        gone.toDF("key").distinct().write.parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema("key string").parquet(f"{self.path}/{folder}").count()

    def commit(self, tables: Mapping[str, DataFrame | Change], meta: Mapping[str, int] | None = None) -> dict:
        """Write the changes and make them the state; a frame alone is a whole table. Old folders stay for their readers."""
        with self.writing():
            old = self.manifest()
            state = {n: [*parts] for n, parts in old["tables"].items()}
            changes = {n: c if isinstance(c, tuple) else (c, None) for n, c in tables.items()}
            with ThreadPoolExecutor(WRITERS) as pool:  # small jobs of their own
                keys = {id(g): pool.submit(self._write_keys, g) for g in {id(g): g for _, g in changes.values() if g is not None and g is not ADDED}.values()}
                rows = {n: pool.submit(self._write, n, r) for n, (r, _) in changes.items() if r is not None}
            for name, (_, gone) in changes.items():
                folder = rows[name].result() if name in rows else None
                if gone is None:
                    state[name] = [self._part(folder)]
                    continue
                parts = [*state.get(name, []), self._part(folder) if gone is ADDED else self._part(folder, *keys[id(gone)].result())]  # tables may share keys
                if len(parts) > MOST_PARTS:
                    parts = [self._part(self._write(name, self._merged(name, parts)))]
                state[name] = parts
            values = old["meta"] | ({"write_epoch": old["meta"].get("write_epoch", 0) + 1} if tables else {}) | dict(meta or {})
            new = {"number": old["number"] + 1, "version": VERSION, "tables": state, "meta": values}
            if not self._create(f"manifests/{new['number']}.json", json.dumps(new)):
                raise Conflict(f"commit {new['number']} is taken")
            return new

    def vacuum(self) -> int:
        """Delete folders that the latest manifest doesn't name; returns how many."""
        parts = [p for parts in self.manifest()["tables"].values() for p in parts]
        live, gone = {p[k] for p in parts for k in ("rows", "gone")}, 0
        root = self._Path(f"{self.path}/tables")
        for f in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if f"tables/{f.getPath().getName()}" not in live:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone
