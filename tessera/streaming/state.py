"""Keyed state in buckets, of which a batch reads and rewrites only those it touches.

Under one folder, batch=<n>/bucket=<b> holds the rows of the bucket's keys after batch n; a bucket's newest version that is older than
a batch is what the batch starts from, so a batch that runs again starts from the same and replaces its own folders. A version
that a later batch has read over is dropped by the batch after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a state; their list is all that the driver holds.
BUCKETS = 256
COLUMN = "bucket"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketState:
    """The rows of keys by buckets under a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, list[int]]:
        """The batches that hold a version of each bucket, in order."""
        path, files = self._files()
        out: dict[int, list[int]] = {}
        for found in files.globStatus(path(f"{self.folder}/batch=*/{COLUMN}=*")) or []:
            bucket, batch = (int(p.getName().split("=")[1]) for p in (found.getPath(), found.getPath().getParent()))
            out.setdefault(bucket, []).append(batch)
        return {b: sorted(v) for b, v in out.items()}

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col(self.key), self.buckets)).distinct().collect())

    def before(self, batch: int, buckets: list[int], schema) -> DataFrame:
        """The rows of the buckets as they were before a batch."""
        held = self.versions()
        newest = {b: max((v for v in held.get(b, []) if v < batch), default=None) for b in buckets}
        paths = [f"{self.folder}/batch={v}/{COLUMN}={b}" for b, v in newest.items() if v is not None]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def write(self, batch: int, rows: DataFrame, buckets: list[int]) -> None:
        """Store all rows of the buckets as they are after a batch; drop what no batch will read again."""
        held = self.versions()
        path, files = self._files()
        files.delete(path(f"{self.folder}/batch={batch}"), True)  # what the batch left when it ran before
        marked = rows.withColumn(COLUMN, bucket_of(F.col(self.key), self.buckets))
        marked.repartition(COLUMN).write.mode("overwrite").partitionBy(COLUMN).parquet(f"{self.folder}/batch={batch}")
        there = {b for b, v in self.versions().items() if batch in v}
        for b in buckets:
            if b not in there:  # all of its rows have gone: an empty version says so
                rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}/{COLUMN}={b}")
            older = [v for v in held.get(b, []) if v < batch]
            for v in older[:-1]:
                files.delete(path(f"{self.folder}/batch={v}/{COLUMN}={b}"), True)

    def rows(self, schema) -> DataFrame:
        """All rows as they are now."""
        return self.before(1 << 62, sorted(self.versions()), schema)
