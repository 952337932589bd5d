"""Tables that are stored and change: a batch rewrites the buckets of its keys, and only once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class StoredTable:
    """A table below `path`, in a folder for each bucket of its keys.

    A batch is merged with the stored rows of its buckets, and the result is staged before it replaces them. The log holds
    a batch as planned when it is staged, and as done when it is in place: one that was cut short in between is
    put in place from what was staged, and is not merged again.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str, keys: list[str], *, buckets: int = 64) -> StoredTable:
        """An empty table below `path`, where nothing is yet."""
        spark.createDataFrame([(json.dumps({"schema": schema, "keys": keys, "buckets": buckets}),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return StoredTable(spark, path, tuple(keys), schema, buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredTable:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return StoredTable(spark, path, tuple(meta["keys"]), meta["schema"], meta["buckets"])

    def _stored(self) -> DataFrame:
        """All rows, with their bucket."""
        empty = self.spark.createDataFrame([], self.schema).schema.add("_bucket", IntegerType())
        if not self._exists(f"{self.path}/data"):
            return self.spark.createDataFrame([], empty)
        return self.spark.read.schema(empty).parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        """All rows."""
        return self._stored().drop("_bucket")

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        folder, system = self._folder(path)
        return system.exists(folder)

    def _delete(self, path: str) -> None:
        folder, system = self._folder(path)
        system.delete(folder, True)

    def _log(self) -> dict[str, list[int]]:
        """The state of each batch: the buckets it touches where it is planned, none where it is done."""
        if not self._exists(f"{self.path}/log"):
            return {}
        rows = self.spark.read.schema("batch string, touched array<int>, done boolean").parquet(f"{self.path}/log").collect()  # a row or two a batch
        done = {r["batch"] for r in rows if r["done"]}
        return {r["batch"]: [] if r["batch"] in done else list(r["touched"]) for r in rows}

    def _note(self, batch: str, touched: list[int], done: bool) -> None:
        self.spark.createDataFrame([(batch, touched, done)], "batch string, touched array<int>, done boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def apply(self, batch: DataFrame, merge: Merge, batch_id: str) -> bool:
        """Merge a batch into the table; False, and no change, if a batch of this id is in it already.

        `merge` gets the stored rows of the batch's buckets and the batch, and returns what these buckets then hold: the
        rows of the batch's keys changed, added or left out, all others as they were. Buckets that no key of the batch
        belongs to are neither read nor written. One batch is applied at a time.
        """
        log, staged = self._log(), f"{self.path}/staged/{batch_id}"
        if batch_id in log and not log[batch_id]:
            return False
        if batch_id not in log:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())
            before = self._stored().where(F.col("_bucket").isin(touched)).drop("_bucket")
            columns = before.columns
            after = merge(before, batch).select(*columns).withColumn("_bucket", bucket)
            after.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(staged)
            self._note(batch_id, touched, False)
        else:
            touched = log[batch_id]
        self._replace(staged, touched)
        self._note(batch_id, [], True)
        self._delete(staged)
        return True

    def _replace(self, staged: str, touched: list[int]) -> None:
        rows = self.spark.read.schema(self._stored().schema).parquet(staged)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/data")
        for bucket in touched:  # of buckets that are now empty nothing is written
            if not self._exists(f"{staged}/_bucket={bucket}"):
                self._delete(f"{self.path}/data/_bucket={bucket}")
