"""Incremental ingestion: a snapshot is stored only if its content differs from the url's last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history
from .state import BUCKETS, BucketState


def store_changes(stream: DataFrame, out: str, checkpoint: str, key: str = "url", order: str = "erisim_zamani", content: str = "icerik_hash", buckets: int = BUCKETS) -> StreamingQuery:
    """Append the changed snapshots of each batch under out/batch=<id>; a batch run again replaces its own folders alone.

    Beside it, <out>_state holds each key's last content in buckets, of which a batch reads and rewrites only those of its keys.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = BucketState(spark, f"{out}_state", key, buckets)
        fresh = history.changes(batch, [key], [order], content)
        seen = history.latest(batch.select(key, order, content), [key], [order])
        touched = state.touched(batch)
        last = state.before(int(number), touched, seen.schema)
        known = last.select(F.col(key).alias("_key"), F.col(content).alias("_content"))
        first = fresh.groupBy(key).agg(F.min_by(content, order).alias("_is"), F.min(order).alias("_at"))
        repeated = first.join(known, (F.col(key) == F.col("_key")) & F.col("_is").eqNullSafe(F.col("_content"))).select(F.col(key), F.col("_at").alias(order))
        fresh = fresh.join(repeated, [key, order], "left_anti")
        seen = history.latest(last.select(key, order, content).unionByName(seen), [key], [order])
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if touched:
            state.write(int(number), seen, touched)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
