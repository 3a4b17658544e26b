"""Keyed tables with change files: replacing or deleting keys writes what changed, reading merges, compaction tidies up.

    path/base/<version>-<buckets>/bucket=<n>/   all rows at that version, in hash buckets of the key, each file sorted by it
    path/changes/<version>/                     rows that replace all rows of their keys, or tombstones (``gone``)

The rows of a key are those of its newest change, or of the base if it has none. A version is finished when Spark has
written its ``_SUCCESS``; a change with a version that is there already replaces it, so a replay changes nothing. The number
of buckets follows the size of the table at compaction. One writer a table at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BYTES = 128 << 20
#: Changes that are read one over the other before ``maintain`` folds them into the base.
MOST_CHANGES = 16
_BUCKET, _VERSION, _GONE = "bucket", "change_version", "gone"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    done = [f.getPath() for f in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted((d.getName() for d in done), key=lambda name: int(name.split("-")[0]))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a folder; 0 if there is none."""
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


@dataclass(frozen=True)
class KeyedTable:
    """``keys`` name a row group; ``by`` (default: the keys) are the key columns that decide its bucket."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(buckets)).cast("int")

    def _bases(self) -> list[str]:
        return _finished(self.spark, f"{self.path}/base")

    def _base(self, before: int | None = None) -> tuple[int, int] | None:
        found = [tuple(map(int, name.split("-"))) for name in self._bases()]
        found = [x for x in found if before is None or x[0] < before]
        return found[-1] if found else None

    def _changes(self, before: int | None = None) -> list[int]:
        base = self._base(before)
        found = [int(v) for v in _finished(self.spark, f"{self.path}/changes")]
        return [v for v in found if (base is None or v > base[0]) and (before is None or v < before)]

    def version(self) -> int:
        """The newest finished version; -1 if there is none."""
        base = self._base()
        return max([base[0] if base else -1, *self._changes()])

    # -- writing -------------------------------------------------------------------

    def _write_base(self, rows: DataFrame, version: int, nbytes: int) -> None:
        buckets = max(1, -(-nbytes // BUCKET_BYTES))
        # a bucket weighs more in memory than on disk: Spark cuts those that outgrow a task into several files
        laid = rows.withColumn(_BUCKET, self._bucket(buckets)).hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, *self.keys)
        laid.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/base/{version}-{buckets}")

    def create(self, rows: DataFrame) -> "KeyedTable":
        """First version, in as many buckets as Spark's estimate of ``rows`` asks for, or as they weigh where it has none."""
        nbytes = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if nbytes < 1 << 50:
            self._write_base(rows, 0, nbytes)
        else:
            self.replace(rows, 0)
            self.compact()
        return self

    def replace(self, rows: DataFrame, version: int | None = None, also: DataFrame | None = None) -> int:
        """The rows of every key in ``rows`` become exactly those given, and keys in ``also`` lose all others. Returns the version."""
        rows = rows.withColumn(_GONE, F.lit(False))
        if also is not None:
            rows = rows.unionByName(also.select(*self.keys).distinct().withColumn(_GONE, F.lit(True)), allowMissingColumns=True)
        return self._change(rows, version)

    def delete(self, keys: DataFrame, version: int | None = None) -> int:
        """All rows of the given keys go."""
        return self._change(keys.select(*self.keys).distinct().withColumn(_GONE, F.lit(True)), version)

    def _change(self, rows: DataFrame, version: int | None) -> int:
        version = self.version() + 1 if version is None else version
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/{version}")
        return version

    # -- reading --------------------------------------------------------------------

    def _changed(self, versions: list[int], schema) -> DataFrame:
        """Newest change of every key that changed."""
        folders = [f"{self.path}/changes/{v}" for v in versions]
        rows = self.spark.read.schema(schema).parquet(*folders)
        rows = rows.withColumn(_VERSION, F.regexp_extract(F.input_file_name(), r"/changes/(\d+)/", 1).cast("long"))
        newest = rows.groupBy(*self.keys).agg(F.max(_VERSION).alias(_VERSION))
        return rows.join(newest, [*self.keys, _VERSION], "left_semi").drop(_VERSION)

    def read(self, keys: DataFrame | None = None, before: int | None = None, like=None) -> DataFrame:
        """Current rows; with ``keys`` only those of these keys (``by`` columns), from the buckets they fall in.

        ``before`` asks for the rows as they were before that version, which a replay needs; ``like`` is the schema of a table
        without a version.
        """
        base, changes = self._base(before), self._changes(before)
        if base is None and not changes:
            if like is not None:
                return self.spark.createDataFrame([], like)
            raise FileNotFoundError(f"no finished version below {self.path}")
        wanted = None if keys is None else keys.select(*(self.by or self.keys)).distinct()
        only = (lambda df: df) if wanted is None else (lambda df: df.join(wanted, list(self.by or self.keys), "left_semi"))
        stored = None
        if base is not None:
            stored = self.spark.read.parquet(f"{self.path}/base/{base[0]}-{base[1]}")
            if wanted is not None and base[1] > 1:
                touched = [r[0] for r in wanted.select(self._bucket(base[1])).distinct().collect()]  # at most the number of buckets
                stored = stored.filter(F.col(_BUCKET).isin(touched))
            stored = only(stored.drop(_BUCKET))
        if not changes:
            return stored
        schema = self.spark.read.parquet(f"{self.path}/changes/{changes[-1]}").schema if stored is None else stored.schema.add(_GONE, "boolean")
        changed = only(self._changed(changes, schema))
        fresh = changed.filter(~F.col(_GONE)).drop(_GONE)
        if stored is None:
            return fresh
        return stored.join(changed.select(*self.keys).distinct(), list(self.keys), "left_anti").unionByName(fresh)

    # -- upkeep ----------------------------------------------------------------------

    def compact(self, keep=None, before: int | None = None) -> None:
        """A new base with all changes (before a version) folded in; older files go. ``keep`` maps the rows to those that stay."""
        changes, base = self._changes(before), self._base(before)
        if not changes:
            return
        rows = self.read(before=before) if keep is None else keep(self.read(before=before))
        nbytes = (size_of(self.spark, f"{self.path}/base/{base[0]}-{base[1]}") if base else 0) + sum(size_of(self.spark, f"{self.path}/changes/{v}") for v in changes)
        self._write_base(rows, changes[-1], nbytes)
        for name in self._bases():
            if int(name.split("-")[0]) < changes[-1]:
                self._drop(f"base/{name}")
        for name in _finished(self.spark, f"{self.path}/changes"):
            if int(name) <= changes[-1]:
                self._drop(f"changes/{name}")

    def maintain(self, keep=None, before: int | None = None, most: int = MOST_CHANGES) -> None:
        """``compact`` once there are ``most`` changes or they weigh more than the base."""
        changes, base = self._changes(before), self._base(before)
        weight = sum(size_of(self.spark, f"{self.path}/changes/{v}") for v in changes)
        if len(changes) >= most or base and weight > max(size_of(self.spark, f"{self.path}/base/{base[0]}-{base[1]}"), 1 << 20):
            self.compact(keep, before)

    def _drop(self, name: str) -> None:
        p, fs = _fs(self.spark, f"{self.path}/{name}")
        fs.delete(p, True)
