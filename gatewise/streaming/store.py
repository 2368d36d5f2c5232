"""A keyed table of mergeable values under one folder, fed by micro-batches.

Every batch appends its changes to a log, one folder per batch, so a retried batch overwrites what it wrote. A
compaction merges the log into a new base; readers take the newest base that was committed and the log after
it. Base and log lie in bucket folders by a hash of the leading key, so a lookup of one key reads one bucket.

Columns are merged by sum, min or max; batches may therefore arrive in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class KeyedStore:
    """``keys`` and ``values`` are DDL column lists; ``merges`` says how each value column is merged."""

    spark: SparkSession
    path: str
    keys: str
    values: str
    merges: dict[str, str]
    buckets: int = 32
    #: Batches after which :meth:`compact_if_due` merges the log.
    every: int = 20

    @property
    def key_names(self) -> list[str]:
        return _schema(self.keys).names

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, folder: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _load(self, name: str, version: str) -> DataFrame:
        fields = _schema(f"{self.keys}, {self.values}, {version} bigint, bucket int")
        if not self._exists(self._folder(name)):
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(self._folder(name))

    def _write(self, rows: DataFrame, folder: str) -> None:
        named = rows.select(*self.key_names, *self.merges, self._bucket(F.col(self.key_names[0])).alias("bucket"))
        # one file per bucket and task; a bucket of a heavy key is split by its other keys
        dealt = named.repartition("bucket", F.pmod(F.xxhash64(*self.key_names), F.lit(4)))
        dealt.sortWithinPartitions("bucket", *self.key_names).write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def put(self, changes: DataFrame, batch_id: int) -> None:
        """Append one batch's changes; the same batch again replaces them."""
        self._write(self._merged(changes), self._folder(f"log/batch={batch_id}"))

    def base(self) -> int:
        """Last batch contained in the committed base, -1 without one."""
        if not self._exists(self._folder("commits")):
            return -1
        return self.spark.read.schema("upto bigint").parquet(self._folder("commits")).agg(F.max("upto")).first()[0]

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key_names).agg(*[_MERGES[how](c).alias(c) for c, how in self.merges.items()])

    def rows(self, before: int | None = None) -> DataFrame:
        """Unmerged rows of the base and of the log after it; with ``before``, of earlier batches only."""
        upto = self.base()
        log = self._load("log", "batch").where(F.col("batch") > upto)
        if before is not None:
            log = log.where(F.col("batch") < before)
        base = self._load("base", "upto").where(F.col("upto") == upto)
        return base.drop("upto").unionByName(log.drop("batch"))

    def read(self, before: int | None = None) -> DataFrame:
        """The merged table."""
        return self._merged(self.rows(before))

    def lookup(self, value) -> DataFrame:
        """The merged rows of one leading key, from its bucket only."""
        key = self.key_names[0]
        typed = F.lit(value).cast(_schema(self.keys)[key].dataType)
        bucket = self.spark.range(1).select(self._bucket(typed)).first()[0]
        return self._merged(self.rows().where((F.col("bucket") == bucket) & F.col(key).eqNullSafe(typed)))

    def compact(self, upto: int, pruned: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Merge the log up to batch ``upto`` into a new base, less what ``pruned`` leaves out of the merged rows.

        The base counts once its commit is written; a compaction that dies before leaves the old one in force.
        """
        merged = self.read(before=upto + 1)
        self._write(pruned(merged) if pruned else merged, self._folder(f"base/upto={upto}"))
        self.spark.createDataFrame([(upto,)], "upto bigint").coalesce(1).write.mode("append").parquet(self._folder("commits"))

    def compact_if_due(self, batch_id: int, pruned: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Called while ``batch_id`` is at work: merges the batches before it, which cannot be retried any more."""
        due = batch_id - 1 - self.base() >= self.every
        if due:
            self.compact(batch_id - 1, pruned)
        return due

    def vacuum(self) -> list[str]:
        """Remove log folders and bases that the committed base has replaced, but for the one before it, which a
        reader may still hold; returns what was removed."""
        upto, gone = self.base(), []
        commits = sorted(r.upto for r in self.spark.read.parquet(self._folder("commits")).collect()) if upto >= 0 else []
        held = commits[-2] if len(commits) > 1 else -1
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name, key in (("log", "batch"), ("base", "upto")):
            top = jvm.org.apache.hadoop.fs.Path(self._folder(name))
            fs = top.getFileSystem(conf)
            for status in fs.listStatus(top) if fs.exists(top) else []:
                number = int(status.getPath().getName().partition("=")[2] or -1)
                if number <= held if name == "log" else number < held:
                    fs.delete(status.getPath(), True)
                    gone.append(status.getPath().getName())
        return sorted(gone)
