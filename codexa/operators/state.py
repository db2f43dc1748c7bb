"""The download cache as stored state: a table in buckets of the key, of which an update reads and writes only those that it touches.

A row keeps, for each column, the last value that is not NULL and the place in the order at which it was set, so that deltas may come late, twice or in any order:
the state is always that of a full replay. The merged buckets are written to the shared folder first and then replace the old ones in one dynamic overwrite; an update that broke off
can simply be run again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.operators import cache
from codexa.staging import drop, stage


@dataclass(frozen=True)
class StoredState:
    """State under `path`: `key`, the columns `values` and, as `order` says, when each was set. order: columns of the updates, their types as DDL; values likewise."""

    spark: SparkSession
    path: str
    key: str
    order: str
    values: str
    buckets: int = 64

    @property
    def _order(self) -> list[str]:
        return [c.split()[0] for c in self.order.split(", ")]

    @property
    def _values(self) -> list[str]:
        return [c.split()[0] for c in self.values.split(", ")]

    @property
    def schema(self) -> str:
        at = "struct<" + ", ".join(re.sub(" ", ": ", c, count=1) for c in self.order.split(", ")) + ">"
        return f"{self.key}, {self.values}, " + ", ".join(f"{v}_at {at}" for v in self._values) + ", bucket int"

    def rows(self) -> DataFrame:
        """The stored rows; none if nothing was stored yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().select(self.key.split()[0], *self._values)

    def _combined(self, rows: DataFrame) -> DataFrame:
        key = self.key.split()[0]
        return rows.groupBy(key, "bucket").agg(*[F.max_by(v, f"{v}_at").alias(v) for v in self._values], *[F.max(f"{v}_at").alias(f"{v}_at") for v in self._values])

    def merge(self, updates: DataFrame) -> list[int]:
        """Takes in updates(key, order, values), NULL meaning unchanged; returns the buckets it wrote, `buckets` at most. Rows without a key are refused."""
        key, seq = self.key.split()[0], F.struct(*self._order)
        own = updates.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
        set_at = [F.when(F.col(v).isNotNull(), seq).alias(f"{v}_at") for v in self._values]
        checked = F.when(F.col(key).isNull(), F.raise_error(F.lit("an update without a key"))).otherwise(F.col(key)).alias(key)
        delta = stage(self._combined(own.select(checked, *self._values, *set_at, "bucket")), "delta")
        touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())
        if touched:
            self._replace(self._combined(self.rows().where(F.col("bucket").isin(touched)).unionByName(delta)))
        drop(delta)
        return touched

    def _replace(self, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", self.schema)]
        held = stage(rows.select(*columns), "state")
        held.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        drop(held)

    def expire(self, now: float, days: float = 90) -> int:
        """Removes failures older than that from the buckets that hold some; returns how many went. A bucket that is left empty keeps no rows."""
        gone = F.coalesce(cache.expired(now, days), F.lit(False))
        found = {r.bucket: r.n for r in self.rows().where(gone).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        if found:
            held = self.rows().where(F.col("bucket").isin(list(found)))
            left = {r.bucket for r in held.where(~gone).select("bucket").distinct().collect()}
            self._replace(held.where(~gone))
            for bucket in set(found) - left:  # an overwrite by partitions leaves those alone that get no row
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return sum(found.values())

    def lookup(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """keys with what the state holds of them and whether it is a hit, and the hits and misses of this look as one row."""
        found = cache.lookup(keys, self.read())
        return found, cache.lookup_counts(found)
