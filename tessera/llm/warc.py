"""Content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256; the exact header block of every record is stored by
itself, with that digest; original records are put together again by a join. The digest is verified
twice: equal digests must come with equal lengths and equal SHA-1 when the archive is written, and the
stored bytes must give their digest again when it is read. Both tables are Parquet, under one folder;
payloads lie in buckets of their digest, so that the headers of large ones travel to them and they stay.
What the summary tells of a payload is measured on the rebuilt record's own bytes.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id is
the response, the others are revisits of it.

Defined results: null html is an empty payload; a null url leaves out WARC-Target-URI, and line ends in
a url are percent-encoded; a null page_id sorts below all others; rows that share the largest page_id
are all responses; repeated rows are records of their own; an empty table gives an empty archive; extra
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_facts, shared_dir

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) to store: headers page_id, digest, header; payloads digest, payload.

    Headers come from a slim table of digests. A payload travels once from each task that reads it,
    however many of the task's records share it, as it is its digest alone that picks it.
    """
    full = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    slim = cut(full.select("page_id", "url", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1")))
    groups = cut(slim.groupBy("digest").agg(
        F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"),
        F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.min("sha1").alias("first"), F.max("sha1").alias("last"),
    ))
    sure = (F.col("least") == F.col("most")) & (F.col("first") == F.col("last"))
    owners = groups.select(
        F.when(sure, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest")))).alias("digest"),
        "owner",
    )
    revisit = (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1" + _END), _field("WARC-Type", kind), _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        _field("WARC-Target-URI", url), _field("WARC-Date", F.lit(DATE)), _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner")))),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))), F.lit(_END),
    )
    hot = hot_keys(groups, "n", slim.count()).select("digest")
    headers = join_facts(slim, owners, ["digest"], hot, ["page_id", "url"]).select("page_id", "digest", F.encode(header, "UTF-8").alias("header"))
    payloads = full.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
    return headers, payloads


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the archive's tables under folder: headers, payloads in buckets of their digest, and layout (the number of buckets)."""
    spark = pages.sparkSession
    headers, payloads = records(pages, revisit_bytes)
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/headers")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"warc_{uuid.uuid4().hex}"
    payloads.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, "digest").option("path", f"{folder}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """digest, header and the header's fields: record_type, page_id, refers_to, content_length."""
    text = F.decode("header", "UTF-8")
    own = lambda name, value: F.regexp_extract(text, f"\n{name}: {value}\r\n", 1)
    number = lambda c: F.when(c.rlike("^-?[0-9]+$"), c).try_cast("long")
    return spark.read.parquet(f"{folder}/headers").select(
        own("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"), "header", own("WARC-Type", "([a-z]+)").alias("record_type"),
        number(own("WARC-Record-ID", "<urn:page:(.*)>")).alias("page_id"), number(own("WARC-Refers-To", "<urn:page:(.*)>")).alias("refers_to"),
        number(own("Content-Length", "([0-9]+)")).alias("content_length"),
    )


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload; fails where stored bytes don't give their digest. Where the archive has a layout they are dealt by digest as they were written."""
    layout = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/layout")
    if layout.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(layout):
        name, buckets = f"warc_{uuid.uuid4().hex}", spark.read.parquet(f"{folder}/layout").first()["buckets"]
        spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}/payloads'")
        stored = spark.table(name)
    else:
        stored = spark.read.parquet(f"{folder}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")
    return stored.select("digest", F.when(right, F.col("payload")).otherwise(wrong).alias("payload"))


def _hot_digests(headers: DataFrame) -> DataFrame:
    """Digests of very many headers: digest, n."""
    counts = headers.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return hot_keys(counts, "n", headers.count())


def responses(spark: SparkSession, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, content_length, record: the exact bytes of every response, its header joined to its payload.

    Payloads of at least revisit_bytes have one response each, so their headers travel to the buckets of payloads, which stay where they
    are read. Smaller ones may have any number and travel by themselves, to salts where they are hot.
    """
    said = read_headers(spark, folder).where("record_type = 'response'").select("page_id", "digest", "content_length", "header")
    payloads = read_payloads(spark, folder)
    large = F.col("content_length") >= revisit_bytes
    small = said.where(~large)
    whole = said.where(large).hint("shuffle_merge").join(payloads, "digest").unionByName(
        join_facts(small, payloads.where(F.octet_length("payload") < revisit_bytes), ["digest"], _hot_digests(small).select("digest"), ["header"])
    )
    return whole.select("page_id", "digest", "content_length", F.concat("header", "payload", F.encode(F.lit(_END * 2), "UTF-8")).alias("record"))


def _body(record: Column, length: Column) -> Column:
    """The bytes of a record between its header and its end; null where they aren't as many as the header says."""
    start = F.position(F.encode(F.lit(_END * 2), "UTF-8"), record) + 2 * len(_END)
    body = F.substr(record, start, length.cast("int"))
    return F.when(F.octet_length(record) == start - 1 + length + 2 * len(_END), body)


def _revisits(spark: SparkSession, folder: str) -> DataFrame:
    return read_headers(spark, folder).where("record_type = 'revisit'")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, record, payload: each record's exact bytes, and its full payload for revisits too."""
    whole = responses(spark, folder)
    payload = _body(F.col("record"), F.col("content_length"))
    own = whole.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "record", payload.alias("payload"))
    again = _revisits(spark, folder)
    hot = _hot_digests(again).select("digest")
    joined = join_facts(again, read_payloads(spark, folder), ["digest"], hot, ["header"])
    record = F.concat("header", F.encode(F.lit(_END * 2), "UTF-8"))
    return own.unionByName(joined.select("page_id", "record_type", "refers_to", record.alias("record"), "payload"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to of every archived record.

    Every response is put together again, and what is told of its payload is measured on the bytes cut out of the rebuilt record, in the task
    that has read them. A revisit takes what its response was found to hold. It fails where a rebuilt record isn't as its header says.
    """
    body = _body(F.col("record"), F.col("content_length"))
    bad = F.raise_error(F.concat(F.lit("a header's Content-Length differs from its body's for payload "), F.col("digest")))
    measured = responses(spark, folder).withColumn("body", body).select(
        "page_id", "digest", F.coalesce(F.octet_length("body").cast("long"), bad.cast("long")).alias("payload_bytes"), F.sha1("body").alias("payload_digest"),
    )
    found = cut(measured)
    facts = found.where(F.col("payload_bytes") > 0).groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = _revisits(spark, folder).select(
        "page_id", "digest", "refers_to",
        F.when(F.col("content_length") == 0, F.lit("revisit")).otherwise(F.raise_error(F.concat(F.lit("a header's Content-Length differs from its body's for payload "), F.col("digest")))).alias("record_type"),
    )
    linked = join_facts(again, facts, ["digest"], _hot_digests(again).select("digest"), ["page_id", "record_type"])
    own = found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(linked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write an archive, into a new folder in the shared one unless one is named, and summarise what is read back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return summary(spark, folder)


ORACLE_SQL = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    g AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
    FROM g"""
