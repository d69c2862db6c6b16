"""Tables that change together: a run is committed as a whole, keyed tables are rewritten by bucket.

A folder holds the files of all tables and one small record per committed run, which names the
files that belong to each table. Files are never changed; a run writes new ones and its
record is put in place last, so readers see the tables of one run or of another, never a mixture.
A run that dies leaves files that no record names.
"""

from __future__ import annotations

import hashlib
import json
import random
import uuid
from collections.abc import Callable, Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallbook.sources.scratch import packed_parquet, step_settings

#: buckets of a keyed table: a run touches few of them, and each fits a task
BUCKETS = 64
#: rows of a bucket at most, where a store is founded for so many rows; a task sorts and joins one bucket, several times a run
BUCKET_ROWS = 50_000


def buckets_for(rows: int, least: int = BUCKETS) -> int:
    """Buckets of a store whose largest keyed table has so many rows: their number grows with the table, not their size."""
    return max(least, -(-rows // BUCKET_ROWS))


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a row, as Spark numbers it."""
    return F.pmod(F.hash(key), F.lit(buckets))


class RunConflict(RuntimeError):
    """Another run was committed since this one began."""


class RunStore:
    """Committed tables under ``folder``.

    ``keyed`` gives the key column of the tables that are kept in buckets; all others consist of
    parts that runs append or replace. One run is written at a time: of two, the second to
    commit gets ``RunConflict``, or fails before where both write one keyed table. ``buckets`` counts for
    keyed tables that are not there yet; see ``buckets_for``.
    """

    def __init__(self, spark: SparkSession, folder: str, keyed: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.keyed, self.buckets = spark, folder.rstrip("/"), keyed or {}, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[str, set[int]] = {}

    # --- records ------------------------------------------------------------------------

    def runs(self) -> list[int]:
        """Numbers of the committed runs, ascending."""
        found = self._files.globStatus(self._path(f"{self.folder}/_runs/*.json")) or []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def record(self, run: int | None = None) -> dict:
        """What a run (the last one) committed; an empty record before the first."""
        done = self.runs()
        if run is None and not done:
            return {"run": -1, "tables": {}}
        if run is not None and run not in done:
            raise ValueError(f"run {run} is not committed in {self.folder}")
        stream = self._files.open(self._path(self._record_path(done[-1] if run is None else run)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _record_path(self, run: int) -> str:
        return f"{self.folder}/_runs/{run:010d}.json"

    def _publish(self, record: dict) -> None:
        """Puts a record in place at once, unless there is one of its number."""
        jvm = self.spark._jvm
        made = f"{self.folder}/_runs/.{uuid.uuid4().hex}"
        stream = self._files.create(self._path(made), False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(made), self._path(self._record_path(record["run"])), options)
        except Py4JJavaError as e:
            self._files.delete(self._path(made), False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise RunConflict(f"run {record['run']} was committed by another writer") from e
            raise

    # --- reading ------------------------------------------------------------------------

    def read(self, name: str, run: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as a run (the last one) left it; of a keyed table only some buckets, if they are given."""
        return self.read_entry(name, self.record(run)["tables"][name], buckets)

    def read_entry(self, name: str, entry: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        if "parts" in entry:
            if not entry["parts"]:
                return self.spark.createDataFrame([], entry["schema"])
            return self.spark.read.schema(entry["schema"]).parquet(*[f"{self.folder}/{p}" for p in entry["parts"]])
        versions = entry["versions"]
        rows = self.spark.table(self._table(name, entry, set(versions)))
        # filters on partition columns only: files of other versions and buckets are not listed
        current = rows.where(F.col("_version") == F.element_at(F.array(*[F.lit(v) for v in versions]), F.col("_bucket") + 1))
        if buckets is not None:
            current = current.where(F.col("_bucket").isin(*buckets))
        return current.drop("_bucket", "_version")

    def _table(self, name: str, entry: dict, versions: set[int]) -> str:
        """The catalogue's name of a keyed table, with all partitions of these versions."""
        table = f"stallbook_{hashlib.md5(f'{self.folder}/{name}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE {table} ({entry['schema']}, _bucket INT, _version BIGINT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (_bucket, _version) "
                f"CLUSTERED BY ({entry['key']}) SORTED BY ({entry['key']}) INTO {len(entry['versions'])} BUCKETS LOCATION '{self.folder}/{name}'")
            self._known[name] = set()
        if not versions - {-1} <= self._known.get(name, set()):
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
            self._known[name] = set(versions)
        return table

    # --- writing ------------------------------------------------------------------------

    def dealt(self, name: str, df: DataFrame) -> DataFrame:
        """Rows for a keyed table that is not there yet, each where its bucket is written: what groups or joins
        them by the key afterwards needs no further shuffle, nor does ``put`` with ``placed``."""
        return df.repartition(self.buckets, self.keyed[name])

    def begin(self) -> Run:
        return Run(self, self.record())

    def vacuum(self, keep: int = 2) -> int:
        """Removes files that none of the last ``keep`` runs names, also those of runs that died; returns how many folders.

        Not to be called while a run is being written.
        """
        named: set[str] = set()
        for run in self.runs()[-keep:]:
            for name, entry in self.record(run)["tables"].items():
                named |= set(entry["parts"]) if "parts" in entry else {f"{name}/_bucket={b}/_version={v}" for b, v in enumerate(entry["versions"])}
        gone = 0
        for pattern in ("*/run=*", "*/_bucket=*/_version=*"):
            for status in self._files.globStatus(self._path(f"{self.folder}/{pattern}")) or []:
                path = status.getPath().toString()
                if path[path.index(self._path(self.folder).toUri().getPath()) + len(self._path(self.folder).toUri().getPath()) + 1:] not in named:
                    self._files.delete(status.getPath(), True)
                    gone += 1
        return gone


class Run:
    """Writes of one run; nothing of it is seen before ``commit``."""

    def __init__(self, store: RunStore, base: dict):
        self.store, self.number = store, base["run"] + 1
        self.tables: dict[str, dict] = {k: dict(v) for k, v in base["tables"].items()}

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table with what this run has written so far."""
        return self.store.read_entry(name, self.tables[name], buckets)

    def _part(self, name: str, df: DataFrame) -> str:
        part = f"{name}/run={self.number}-{uuid.uuid4().hex}"
        with step_settings(self.store.spark):
            packed_parquet(df).save(f"{self.store.folder}/{part}")
        return part

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The whole table anew."""
        self.tables[name] = {"schema": _ddl(df), "parts": [self._part(name, df)]}
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows in addition; what is stored is not read. Returns them as they are stored."""
        entry = self.tables.get(name) or {"schema": _ddl(df), "parts": []}
        columns = self.store.spark.createDataFrame([], entry["schema"]).columns
        part = self._part(name, df.select(*columns))
        self.tables[name] = entry | {"parts": [*entry["parts"], part]}
        return self.store.read_entry(name, entry | {"parts": [part]})

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of a keyed table that hold the keys of some rows, or would; as many as there are buckets at most."""
        key, n = self.store.keyed[name], self._buckets(name)
        return sorted(r[0] for r in keys.select(bucket_of(key, n).alias("b")).distinct().collect())

    def _buckets(self, name: str) -> int:
        return len(self.tables[name]["versions"]) if name in self.tables else self.store.buckets

    def put(self, name: str, df: DataFrame, buckets: Sequence[int] | None = None, placed: bool = False) -> DataFrame:
        """All rows of some buckets (of the whole table) anew; the files of other buckets stay as they are.

        ``placed`` rows come out of a join with the stored table, or of ``dealt`` ones, and lie in its buckets already.
        Returns the rows as they are stored.
        """
        key, n = self.store.keyed[name], self._buckets(name)
        entry = self.tables.get(name) or {"key": key, "schema": _ddl(df), "versions": [-1] * n}
        columns = self.store.spark.createDataFrame([], entry["schema"]).columns
        version = self.number * 10**9 + random.SystemRandom().randrange(10**9)
        table = self.store._table(name, entry, set())
        rows = df.select(*columns, bucket_of(key, n).alias("_bucket"), F.lit(version).cast("long").alias("_version"))
        rows = rows if placed else rows.repartition(n, key)
        with step_settings(self.store.spark):
            (rows.write.mode("append").format("parquet").partitionBy("_bucket", "_version").bucketBy(n, key).sortBy(key)
             .option("path", f"{self.store.folder}/{name}").saveAsTable(table))
        self.store._known.setdefault(name, set()).add(version)
        wanted = set(range(n) if buckets is None else buckets)
        self.tables[name] = entry | {"versions": [version if b in wanted else v for b, v in enumerate(entry["versions"])]}
        return self.read(name, sorted(wanted))

    def update(self, name: str, changes: DataFrame, change: Callable[[DataFrame], DataFrame], more: Iterable[int] = ()) -> DataFrame:
        """``change`` of the buckets that hold keys of ``changes`` (and of ``more``), which gets their stored rows.

        The stored rows are read as they lie: a join on the key shuffles the changes only.
        """
        buckets = sorted({*self.touched(name, changes), *more})
        return self.put(name, change(self.read(name, buckets)), buckets, placed=True)

    def note(self, name: str, **values) -> None:
        """Small facts about a table that later runs read from the record."""
        self.tables[name] = self.tables[name] | values

    def commit(self) -> int:
        """Makes all writes of the run visible at once; RunConflict if another run came first."""
        self.store._publish({"run": self.number, "tables": self.tables})
        return self.number


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
