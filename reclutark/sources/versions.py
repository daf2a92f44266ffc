"""Stored tables in versions: immutable files, a manifest as the one point of commit, storage by hash, and an index of files.

A store is a folder.  ``data/`` holds files that are written once and never changed; ``manifests/`` holds one numbered file per version, which names the
files of every table.  A reader takes the newest manifest, so all tables of a change appear together or not at all: what a failed job
wrote is named by no manifest.  Two writers can't both commit on top of the same version: manifests are created, never replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reclutark.operators import changes

BUCKET = "cubo"

#: An index bitmap has this many bits (those of ``bitmap_construct_agg``), for so many keys, each of which sets so many.
BITS, KEYS_PER_MAP, BITS_PER_KEY = 32768, 2500, 5


class Conflict(Exception):
    """Another writer committed first; the change has to be worked out again from the new version."""


@dataclass(frozen=True)
class Table:
    """Where a table's files are: folders by bucket (one bucket without a key), and by indexed column the folder and number of bitmaps."""

    schema: str
    key: str | None = None
    buckets: int = 1
    folders: dict[str, list[str]] = field(default_factory=dict)
    indexes: dict[str, list] = field(default_factory=dict)


def bucket_of(key: str, buckets: int, columns: Sequence[str] = ()) -> Column:
    """Bucket of a row.  Rows without a key are never looked up by it, so they are dealt by all their columns."""
    of_key = F.xxhash64(F.col(key))
    if columns:
        of_key = F.when(F.col(key).isNotNull(), of_key).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    return F.pmod(of_key, F.lit(buckets)).cast("int")


class _Files:
    """The few calls of the file system that Spark's readers and writers don't offer; any store that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = root

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.system(folder).listStatus(self.path(folder)))

    def create(self, name: str, text: str) -> None:
        """A new file that appears whole; an error if the name is taken."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.system(draft).create(self.path(draft), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        no_options = self.gateway.new_array(getattr(fs, "Options$Rename"), 0)  # so the target must not exist
        try:
            context.rename(self.path(draft), self.path(name), no_options)
        except Py4JJavaError as error:
            self.remove(draft)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise FileExistsError(name) from error
            raise

    def remove(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def modified(self, name: str) -> int:
        return self.system(name).getFileStatus(self.path(name)).getModificationTime()


class Store:
    """Tables below ``root``, by version.  Version 0 has no table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def versions(self) -> list[int]:
        """Committed versions, the oldest first."""
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json")]

    def tables(self, version: int | None = None) -> dict[str, Table]:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0]
        return {name: Table(**entry) for name, entry in json.loads(text).items()}

    def read(self, name: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """A table as of a version, the newest by default; only the buckets that may hold ``keys``, if given."""
        table = self.tables(version)[name]
        return self.of(table, None if keys is None else self.buckets(table, keys))

    def of(self, table: Table, buckets: Sequence[str] | None = None) -> DataFrame:
        folders = [f for b, of in table.folders.items() if buckets is None or b in buckets for f in of]
        return self._files(table, folders)

    def _files(self, table: Table, names: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])

    def buckets(self, table: Table, keys: DataFrame) -> list[str]:
        """Buckets that may hold the keys; there are no more than the table has."""
        if table.key is None:
            return list(table.folders)
        kind = T.StructType.fromJson(json.loads(table.schema))[table.key].dataType
        rows = keys.select(F.col(table.key).cast(kind).alias(table.key)).where(F.col(table.key).isNotNull())
        return [str(r[0]) for r in rows.select(bucket_of(table.key, table.buckets)).distinct().collect()]

    def lookup(self, name: str, column: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows whose ``column`` is among the keys, from the files that may hold them by the column's index.

        A file's index is its least and greatest value and a Bloom filter in parts: a key falls in one bitmap of the file and sets some of its bits there.  Keys
        meet the bitmaps by an equal-key join; the driver sees names of files.
        """
        table = self.tables(version)[name]
        kind = T.StructType.fromJson(json.loads(table.schema))[column].dataType
        wanted = keys.select(F.col(column).cast(kind).alias(column)).where(F.col(column).isNotNull()).distinct()
        current = [f for of in table.folders.values() for f in of]
        found: set[str] = set()
        for folder, maps in table.indexes[column]:
            index = self.spark.read.parquet(f"{self.root}/{folder}")
            asked = wanted.select(F.col(column).alias("_valor"), *_positions(F.col(column), maps))
            held = asked.join(index, "tramo").where(F.col("_valor").between(F.col("minimo"), F.col("maximo")))
            for k in range(BITS_PER_KEY):
                held = held.where(_bit(F.col("mapa"), F.col(f"_bit{k}")))
            found |= {r[0] for r in held.select("archivo").distinct().collect()}
        files = sorted(f for f in found if f.rpartition("/")[0] in current)
        return self._files(table, files).join(wanted, column, "left_semi").select(*T.StructType.fromJson(json.loads(table.schema)).names)

    def bounds(self, name: str, column: str, version: int | None = None) -> DataFrame:
        """Least and greatest value of an indexed column (minimo, maximo), from the index alone: no file of the table is opened."""
        table = self.tables(version)[name]
        current = [f for of in table.folders.values() for f in of]
        kind = T.StructType.fromJson(json.loads(table.schema))[column].dataType.simpleString()
        zones = self.spark.createDataFrame([], f"archivo string, minimo {kind}, maximo {kind}")
        for folder, _ in table.indexes[column]:
            zones = zones.unionByName(self.spark.read.parquet(f"{self.root}/{folder}").select("archivo", "minimo", "maximo"))
        inside = F.regexp_replace("archivo", "/[^/]*$", "").isin(current)
        return zones.where(inside).agg(F.min("minimo").alias("minimo"), F.max("maximo").alias("maximo"))

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 2, older_than_seconds: int = 86_400) -> list[str]:
        """Removes all manifests but the newest ``keep``, and files that none of those names; returns the removed folders.

        Files younger than the given age stay, as a running change may be about to name them.
        """
        known = self.versions()
        kept = {"/".join(f.split("/")[:2]) for v in known[-keep:] for t in self.tables(v).values() for f in _folders(t)}
        for version in known[:-keep]:
            self.files.remove(f"manifests/{version:012d}.json")
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        old = [f"data/{n}" for n in self.files.names("data")]
        old = [f for f in old if f not in kept and now - self.files.modified(f) >= 1000 * older_than_seconds]
        for folder in old:
            self.files.remove(folder)
        return old


def _folders(table: Table) -> list[str]:
    return [f for of in table.folders.values() for f in of] + [folder for of in table.indexes.values() for folder, _ in of]


def _positions(value: Column, maps: int) -> list[Column]:
    """The bitmap that a value falls in, and its bits there."""
    bits = [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(BITS)).alias(f"_bit{k}") for k in range(BITS_PER_KEY)]
    return [F.pmod(F.xxhash64(value), F.lit(maps)).cast("int").alias("tramo"), *bits]


def _bit(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


class Change:
    """The next version of a store while it is worked out; nothing of it is seen before :meth:`commit`."""

    def __init__(self, store: Store):
        self.store = store
        known = store.versions()
        self.base = known[-1] if known else 0
        self.tables = store.tables(self.base)

    def read(self, name: str) -> DataFrame:
        """A table as this change has it so far."""
        return self.store.of(self.tables[name])

    def put(self, name: str, rows: DataFrame, key: str | None = None, buckets: int = 1, index: Sequence[str] = ()) -> None:
        """The whole table anew: in ``buckets`` by the hash of ``key``, with an index of files for each column of ``index``."""
        table = Table(rows.schema.json(), key, buckets if key else 1, {}, {c: [] for c in index})
        self.tables[name] = self._with(table, rows)

    def add(self, name: str, rows: DataFrame) -> None:
        """Further rows, in new files of their buckets; no stored row is read."""
        self.tables[name] = self._with(self.tables[name], rows)

    def patch(self, name: str, edits: DataFrame, columns: Sequence[str]) -> None:
        """Rows of the keys in ``edits`` with the listed columns overwritten; ``edits`` holds each key once.

        Only the buckets of those keys are read, and written anew.  Keys that the table doesn't hold change nothing.
        """
        table = self.tables[name]
        touched = [b for b in self.store.buckets(table, edits) if b in table.folders]
        if not touched:
            return
        after = changes.overlay(self.store.of(table, touched), edits, table.key, columns)
        rest = {b: of for b, of in table.folders.items() if b not in touched}
        self.tables[name] = self._with(replace(table, folders=rest), after)

    def commit(self) -> int:
        """Makes the change the newest version; :class:`Conflict` if another one is by now."""
        number = self.base + 1
        try:
            self.store.files.create(f"manifests/{number:012d}.json", json.dumps({n: asdict(t) for n, t in self.tables.items()}))
        except FileExistsError as taken:
            raise Conflict(f"version {number} was committed by another writer") from taken
        return number

    def _with(self, table: Table, rows: DataFrame) -> Table:
        """The table with the rows in new files."""
        folder = f"data/{uuid.uuid4().hex}"
        names = T.StructType.fromJson(json.loads(table.schema)).names
        rows = rows.select(*[F.col(f"`{c}`") for c in names])
        # A bucket with most rows is split over several files by adaptive execution.
        if table.key is None:
            rows.write.parquet(f"{self.store.root}/{folder}")
            new = {"0": [folder]}
        else:
            dealt = rows.withColumn(BUCKET, bucket_of(table.key, table.buckets, names)).hint("rebalance", BUCKET)
            dealt.write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
            parts = [n for n in self.store.files.names(folder) if n.startswith(f"{BUCKET}=")]
            new = {p.partition("=")[2]: [f"{folder}/{p}"] for p in parts}
        folders = {b: [*table.folders.get(b, []), *new.get(b, [])] for b in {**table.folders, **new}}
        indexes = {c: [*of, *self._index(table, [f for fs in new.values() for f in fs], c)] for c, of in table.indexes.items()}
        return replace(table, folders=folders, indexes=indexes)

    def _index(self, table: Table, folders: Sequence[str], column: str) -> list[list]:
        """Index of the new files: a row per file and bitmap, with the file's least and greatest value; files of nulls alone have none."""
        if not folders:
            return []
        file = F.regexp_extract("_metadata.file_path", r"(data/[0-9a-f]{32}/.*)$", 1).alias("archivo")
        rows = self.store._files(table, folders).select(file, F.col(f"`{column}`").alias("valor")).where(F.col("valor").isNotNull())
        zones = rows.groupBy("archivo").agg(F.min("valor").alias("minimo"), F.max("valor").alias("maximo"), F.count("*").alias("filas"))
        most = zones.agg(F.max("filas")).first()[0]
        if most is None:
            return []
        maps = -(-most // KEYS_PER_MAP)
        bits = rows.select("archivo", *_positions(F.col("valor"), maps))
        each = bits.select("archivo", "tramo", F.explode(F.array(*[f"_bit{k}" for k in range(BITS_PER_KEY)])).alias("lugar"))
        maps_of = each.groupBy("archivo", "tramo").agg(F.bitmap_construct_agg("lugar").alias("mapa"))
        folder = f"data/{uuid.uuid4().hex}"
        maps_of.join(zones.drop("filas"), "archivo").write.parquet(f"{self.store.root}/{folder}")
        return [[folder, maps]]
