"""A result store that grows: rows by id, added in runs, known by a small index of ids.

Every save adds one run below the store, dealt by the id's hash into as many
buckets as its rows need, and never rewrites another.  Beside the runs stands
an index (id, run) in runs of its own, which are merged eight at a time, so
there are at most eight of each size: an id is looked for in one bucket of each.
What counts is listed in the newest manifest; a run without one is not part of
the store and is written over by the next save.  One writer at a time.

    store/store_run=<n>/store_bucket=<k>/*.parquet   the rows
    store/_ids/<run>/store_bucket=<k>/*.parquet      the index
    store/_manifest/<n>.json                         version n of the list of index runs
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 20_000
RUNS_PER_TIER = 8
MOST_BITS = 24
KEPT_VERSIONS = 8
# a batch that touches more buckets than this reads its index runs whole
PROBES = 10_000


@dataclass(frozen=True)
class IndexRun:
    name: str
    bits: int
    rows: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    index: tuple[IndexRun, ...] = field(default_factory=tuple)


def bits_for(rows: int, per_bucket: int) -> int:
    """So many bits of the hash that a bucket holds `per_bucket` rows or less on average."""
    return min(MOST_BITS, max(0, (max(rows, 1) - 1) // per_bucket).bit_length())


def id_bucket(value: Column, bits: int) -> Column:
    """The first bits of the hash of an id; ids of any type are placed by their text."""
    hashed = F.xxhash64(value.cast("string"))
    return (F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0)).cast("int")


class Store:
    """Rows of one schema with an id column, in a folder that every task can reach."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.id_col, self.rows_per_bucket = spark, path.rstrip("/"), id_col, rows_per_bucket
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files of the driver: a few names, never rows ---

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []

    def _delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.path}/{name}"), True)

    def manifest(self) -> Manifest:
        """The newest version; version 0 is a store without rows."""
        versions = [int(n.removesuffix(".json")) for n in self._names(f"{self.path}/_manifest") if n.endswith(".json")]
        return self._version(max(versions)) if versions else Manifest()

    def _version(self, n: int) -> Manifest:
        told = json.loads(self.spark.read.text(f"{self.path}/_manifest/{n}.json", wholetext=True).first()[0])
        return Manifest(told["version"], told["schema"], tuple(IndexRun(**r) for r in told["index"]))

    def _commit(self, new: Manifest) -> None:
        """Publish a version by renaming a whole file, then let go of what only old versions name."""
        made, shown = (self._path(f"{self.path}/_manifest/{new.version}.{end}") for end in ("made", "json"))
        if self._files.exists(shown):
            raise RuntimeError(f"another writer has saved version {new.version} of {self.path}")
        out = self._files.create(made, True)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        if not self._files.rename(made, shown):
            raise RuntimeError(f"version {new.version} of {self.path} could not be saved")
        self._forget(new)

    def _forget(self, new: Manifest) -> None:
        oldest = new.version - KEPT_VERSIONS
        if oldest < 1 or not self._files.exists(self._path(f"{self.path}/_manifest/{oldest}.json")):
            return
        after = {r.name for n in range(oldest + 1, new.version + 1) for r in self._version(n).index}
        for run in self._version(oldest).index:
            if run.name not in after:
                self._delete(f"_ids/{run.name}")
        self._delete(f"_manifest/{oldest}.json")

    # --- writing ---

    def save(self, rows: DataFrame, mode: str = "append", count: int | None = None) -> int:
        """Add rows as a run and return their number; `overwrite` drops the runs before.

        The number of buckets, and so of writing tasks, follows the number of
        rows (`count`, if it is known already).  Rows of an id that the store
        holds are added beside them; `unseen` tells which are new.
        """
        if mode not in ("append", "overwrite"):
            raise ValueError(f"no such mode: {mode}")
        old = self.manifest()
        version = old.version + 1
        kept = old.index if mode == "append" else ()
        count = rows.count() if count is None else count
        if count:
            bits = bits_for(count, self.rows_per_bucket)
            self._write(rows, f"store_run={version}", bits)
            written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/store_run={version}")
            entries = written.select(F.col(self.id_col).alias("id"), F.lit(version).alias("run"), F.lit(bits).alias("bits"))
            self._write(entries, f"_ids/{version}", bits, "id")
            kept = self._merged((*kept, IndexRun(str(version), bits, count, 0)), version)
        self._commit(Manifest(version, rows.schema.json(), kept))
        if mode == "overwrite":
            for name in self._names(self.path):
                if name.startswith("store_run=") and name != f"store_run={version}":
                    self._delete(name)
        return count

    def _write(self, rows: DataFrame, name: str, bits: int, id_col: str | None = None) -> None:
        """One task and file for each bucket, sorted by id, so that statistics inside a file narrow a lookup further."""
        key = id_col or self.id_col
        placed = rows.withColumn("store_bucket", id_bucket(F.col(key), bits))
        # by number: ranges would be found by working all rows out a first time
        placed = placed.repartitionById(1 << bits, F.col("store_bucket").cast("int"))
        (placed.sortWithinPartitions("store_bucket", key).write.mode("overwrite").partitionBy("store_bucket")
         .parquet(f"{self.path}/{name}"))

    def _merged(self, index: tuple[IndexRun, ...], version: int) -> tuple[IndexRun, ...]:
        """Merge a tier that is full into one run of the next; only ids are read and written."""
        tier = 0
        while len(full := [r for r in index if r.tier == tier]) >= RUNS_PER_TIER:
            count = sum(r.rows for r in full)
            run = IndexRun(f"{version}-{tier + 1}", bits_for(count, self.rows_per_bucket), count, tier + 1)
            self._write(self._entries([f"{self.path}/_ids/{r.name}" for r in full]), f"_ids/{run.name}", run.bits, "id")
            index = (*(r for r in index if r.tier != tier), run)
            tier += 1
        return index

    # --- reading ---

    def _entries(self, paths: list[str]) -> DataFrame:
        # not one table with partitions: runs have buckets of different widths
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)

    def read(self) -> DataFrame:
        """All rows of the store."""
        now = self.manifest()
        schema = T.StructType.fromJson(json.loads(now.schema)) if now.schema else T.StructType()
        if not now.index:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("store_run", T.IntegerType()),
                                                    T.StructField("store_bucket", T.IntegerType())])).parquet(self.path)
        return rows.where(F.col("store_run") <= now.version).drop("store_run", "store_bucket")

    def index_paths(self, ids: DataFrame, column: str) -> list[str]:
        """The index folders where these ids can be: one bucket of each run for each id, or whole runs for very many."""
        index = self.manifest().index
        if not index:
            return []
        most = max(r.bits for r in index)
        touched = [r[0] for r in ids.select(id_bucket(F.col(column), most)).distinct().limit(PROBES + 1).collect()]
        if len(touched) > PROBES:
            return [f"{self.path}/_ids/{r.name}" for r in index]
        out = []
        for r in index:
            there = set(self._names(f"{self.path}/_ids/{r.name}"))
            wanted = {f"store_bucket={b >> (most - r.bits)}" for b in touched}
            out += [f"{self.path}/_ids/{r.name}/{n}" for n in sorted(there & wanted)]
        return out

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose id the store does not hold.

        Only the index buckets of these ids are opened, a few for each size of
        run.  Null ids are an id like any other.  `rows` is read twice.
        """
        paths = self.index_paths(rows, self.id_col)
        if not paths:
            return rows
        known = self._entries(paths).select(F.col("id").alias("store_id"))
        return rows.join(known, rows[self.id_col].eqNullSafe(known["store_id"]), "left_anti")

    def lookup(self, value) -> DataFrame:
        """All rows of one id; no row means not found.  One bucket of every index run and of every run that holds it is opened."""
        now = self.manifest()
        one = self.spark.range(1).select(F.lit(value).alias("id"))
        paths = self.index_paths(one, "id")
        held = []
        if paths:
            found = self._entries(paths).where(F.col("id") == F.lit(value)).select("run", "bits").distinct()
            held = [(r["run"], r["bits"]) for r in found.collect()]  # the runs that hold this id
        schema = T.StructType.fromJson(json.loads(now.schema)) if now.schema else T.StructType()
        if not held:
            return self.spark.createDataFrame([], schema)
        buckets = one.select(*[id_bucket(F.col("id"), bits).alias(f"b{i}") for i, (_, bits) in enumerate(held)]).first()
        folders = [f"{self.path}/store_run={run}/store_bucket={b}" for (run, _), b in zip(held, buckets)]
        return self.spark.read.schema(schema).parquet(*folders).where(F.col(self.id_col) == F.lit(value))
