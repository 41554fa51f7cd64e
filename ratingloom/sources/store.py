"""A keyed table that takes small batches: rows in hash buckets, deltas beside them, a manifest that is swapped last.

A batch writes its own rows, by bucket, and nothing else. The manifest, a small JSON file with a number, names
each bucket's base and deltas; the largest number counts. A batch that fails before its manifest is there has
changed nothing. A point read opens one bucket. A bucket whose deltas are many is written anew, alone.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..files import erased, note

#: Deltas of a bucket after which a batch has it written anew.
DELTAS = 16


class Conflict(RuntimeError):
    """Another writer's manifest came first; the batch is to be put again."""


@dataclasses.dataclass(frozen=True)
class Store:
    """Rows of ``schema`` by ``keys`` below ``path``, in ``buckets`` hash buckets."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: tuple[str, ...], buckets: int = 64) -> Store:
        """A new, empty store; an error where there is one already."""
        parsed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        store = cls(spark, path, parsed, keys, buckets)
        store._swap({"version": 0, "schema": parsed.jsonValue(), "keys": list(keys), "buckets": buckets, "parts": {}})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        manifest = _manifest(spark, path)
        return cls(spark, path, StructType.fromJson(manifest["schema"]), tuple(manifest["keys"]), manifest["buckets"])

    def put(self, rows: DataFrame) -> int:
        """Rows in place of those with the same keys; the store's new version. Of rows of one key in a batch any counts."""
        return self._add(rows.select(*self.schema.fieldNames()).withColumn("__gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Take the rows with these keys out; the store's new version."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.keys]
        return self._add(keys.select(*self.keys, *rest).select(*self.schema.fieldNames()).withColumn("__gone", F.lit(True)))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as they are now or were in a version that hasn't been compacted since."""
        parts = _manifest(self.spark, self.path, version)["parts"]
        return self._latest([f for of in parts.values() for f in of])

    def get(self, *key: object) -> DataFrame:
        """The row of a key, if there is one: one bucket is opened."""
        fields = [self.schema[k] for k in self.keys]
        values = [F.lit(v).cast(f.dataType) for v, f in zip(key, fields, strict=True)]
        bucket = self.spark.range(1).select(self._bucket(values)).first()[0]
        same = [F.col(k).eqNullSafe(v) for k, v in zip(self.keys, values)]
        files = _manifest(self.spark, self.path)["parts"].get(str(bucket), [])
        found = self._latest(files, same)
        return found

    def files(self, *key: object) -> list[str]:
        """The folders that get() opens for a key."""
        fields = [self.schema[k] for k in self.keys]
        bucket = self.spark.range(1).select(self._bucket([F.lit(v).cast(f.dataType) for v, f in zip(key, fields, strict=True)])).first()[0]
        return [f"{self.path}/{folder}" for folder, _ in _manifest(self.spark, self.path)["parts"].get(str(bucket), [])]

    def compact(self, least: int = 1) -> int:
        """Write the buckets that have more than ``least`` folders anew, each as one; the store's new version. What no version names any more is deleted."""
        manifest = _manifest(self.spark, self.path)
        full = [b for b, of in manifest["parts"].items() if len(of) > least]
        if not full:
            return manifest["version"]
        old = [f for b in full for f in manifest["parts"][b]]
        now = self._written(self._latest(old).withColumn("__gone", F.lit(False)), manifest["version"] + 1)
        parts = {b: of for b, of in manifest["parts"].items() if b not in full} | {b: [f] for b, f in now.items()}
        version = self._swap(manifest | {"version": manifest["version"] + 1, "parts": parts})
        for folder, _ in old:
            erased(self.spark, f"{self.path}/{folder}")
        return version

    def _bucket(self, keys: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, version: int) -> dict[str, list]:
        """Each bucket's folder of these rows, with the version they belong to."""
        name = f"rows-{version:09d}-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket([F.col(k) for k in self.keys])).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        return {f.removeprefix("__bucket="): [f"{name}/{f}", version] for f in _names(self.spark, f"{self.path}/{name}") if f.startswith("__bucket=")}

    def _add(self, rows: DataFrame) -> int:
        manifest = _manifest(self.spark, self.path)
        added = self._written(rows, manifest["version"] + 1)
        parts = dict(manifest["parts"])
        for bucket, folder in added.items():
            parts[bucket] = [*parts.get(bucket, []), folder]
        version = self._swap(manifest | {"version": manifest["version"] + 1, "parts": parts})
        return self.compact(DELTAS) if any(len(of) > DELTAS for of in parts.values()) else version

    def _latest(self, folders: list[list], same: list[Column] = ()) -> DataFrame:
        """The last row of each key in these folders, deleted ones left out. A key's rows lie in one bucket and are at most one a delta."""
        schema = StructType([*self.schema.fields]).add("__gone", "boolean")
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        by_version: dict[int, list[str]] = {}
        for folder, version in folders:
            by_version.setdefault(version, []).append(f"{self.path}/{folder}")
        every = None
        for version, paths in by_version.items():
            rows = self.spark.read.schema(schema).parquet(*paths).withColumn("__version", F.lit(version))
            every = rows if every is None else every.unionByName(rows)
        for condition in same:
            every = every.where(condition)
        names = self.schema.fieldNames()
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*[n for n in names if n not in self.keys], "__gone"), "__version").alias("__last"))
        return last.where("not __last.__gone").select(*[F.col(n) if n in self.keys else F.col(f"__last.{n}").alias(n) for n in names])

    def _swap(self, manifest: dict) -> int:
        """Make a manifest the store's: it is written beside and then renamed, which fails where the number is taken."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        draft, final = (jvm.Path(f"{self.path}/{name}") for name in (f"_draft-{uuid.uuid4().hex}", f"_manifest-{manifest['version']:09d}.json"))
        files = final.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")
        return manifest["version"]


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    found = [n for n in _names(spark, path) if n.startswith("_manifest-")]
    name = found[-1] if version is None else f"_manifest-{version:09d}.json"
    return json.loads(note(spark, f"{path}/{name}"))
