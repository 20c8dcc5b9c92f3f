"""Where results go: idempotent inserts, complaints, audit rows, raw snapshots, indexes, reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import masked, scope, titled_chunks
from ..operators import complaints, history, retrieval
from .state import BUCKETS, BucketState


def insert_missing(stored: DataFrame, new: DataFrame, key: str, refresh: str, fields: list[str]) -> DataFrame:
    """stored with refresh taken from new where a key is known, and unknown keys added with null fields; status kept, refreshed or added.

    Run again with the same new it changes nothing. Rows of new with a null key are left out; of several with one key the greatest refresh counts.
    """
    fresh = new.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(refresh).alias("_fresh"))
    joined = stored.withColumn("_there", F.lit(True)).join(fresh, F.col(key) == F.col("_key"), "full_outer")
    status = F.when(F.col("_there").isNull(), "added").when(F.col("_key").isNull(), "kept").otherwise("refreshed")
    return joined.select(
        F.coalesce(key, "_key").alias(key), F.coalesce("_fresh", refresh).alias(refresh), *[F.when(F.col("_there"), F.col(f)).alias(f) for f in fields], status.alias("status")
    )


def save_complaints(rows: DataFrame, permits: DataFrame, today: Column, path: str, source: str = "source", text: str = "text") -> None:
    """Append the masked texts of permitted sources alone; what was said as it was is never stored."""
    allowed = complaints.permitted(rows, permits, source, today)
    allowed.withColumn(text, masked(F.col(text))["text"]).write.mode("append").parquet(path)


def append_audit(rows: DataFrame, path: str, at: Column) -> None:
    """Append audit rows by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def write_snapshots(rows: DataFrame, path: str, bank: str = "banka", at: str = "erisim_zamani") -> None:
    """Append raw snapshots as JSON by bank and day."""
    rows.withColumns({"_bank": F.col(bank), "_day": F.substring(at, 1, 10)}).write.mode("append").partitionBy("_bank", "_day").json(path)


def migrated(rows: DataFrame, text: str, marker: str) -> DataFrame:
    """rows with the text cut at the marker, and changed; the stored content hash isn't touched."""
    return rows.withColumn("_old", F.col(text)).withColumn(text, scope(F.col(text), marker)).withColumn("changed", F.col("_old") != F.col(text)).drop("_old")


def write_index(docs: DataFrame, path: str, key: str, text: str, title: Column) -> None:
    """Write an index anew: chunks (key, position, chunk), each content once, and their postings."""
    chunks = docs.select(key, F.posexplode(titled_chunks(F.col(text), title)).alias("position", "chunk"))
    chunks = chunks.withColumn("chunk_id", F.concat_ws("#", F.col(key).cast("string"), F.lpad(F.col("position").cast("string"), 6, "0")))
    first = history.keep_first(chunks.select("chunk_id", "chunk"), "chunk", "chunk_id").select("chunk_id")
    chunks.join(first, "chunk_id", "left_semi").write.mode("overwrite").parquet(f"{path}/chunks")
    kept = docs.sparkSession.read.parquet(f"{path}/chunks")
    retrieval.postings(kept, "chunk_id", "chunk").write.mode("overwrite").parquet(f"{path}/postings")


def update_index(spark: SparkSession, batch: int, path: str, docs: DataFrame, dropped: DataFrame, key: str, text: str, title: Column | None = None, buckets: int = BUCKETS) -> dict[str, int]:
    """Take added and changed documents into an index, and dropped ones (their keys) out: chunks of a document, with their postings.

    The index is a keyed state (see streaming.state): only buckets of documents named are rewritten, and a batch that runs again does the
    same again. Returns how many documents came, went, and stay, how many chunks they have, and how many buckets were written.
    """
    state = BucketState(spark, path, key, buckets)
    title = F.lit(None).cast("string") if title is None else title
    made = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(titled_chunks(F.col(text), title)).alias("place", "chunk"))
    rows = made.select(key, "place", "chunk", retrieval.tokens(F.col("chunk")).alias("terms"))
    gone = docs.select(key).unionByName(dropped.select(key)).distinct()
    touched = state.touched(gone)
    if not touched:
        held = state.rows(rows.schema)
        return {"came": 0, "went": 0, "stay": held.select(key).distinct().count(), "chunks": held.count(), "buckets": 0}
    old = state.before(batch, touched, rows.schema)
    went = old.select(key).distinct().join(dropped.select(key).distinct(), key, "left_semi").join(docs.select(key), key, "left_anti").count()
    state.write(batch, old.join(gone, key, "left_anti").unionByName(rows), touched)
    held = state.rows(rows.schema)
    counted = held.agg(F.count_distinct(key).alias("n"), F.count(F.lit(1)).alias("c")).first()
    return {"came": rows.select(key).distinct().count(), "went": went, "stay": counted["n"], "chunks": counted["c"], "buckets": len(touched)}


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest of one JSON file; for the small tables that manifests are."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def markdown(title: str, parts: dict[str, DataFrame], most: int = 1000) -> str:
    """A report of small tables as Markdown; a table of over most rows is an error, as it is no report."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows")
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]
    return "\n".join(out) + "\n"
