"""Raw snapshots and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "banka string, kategori string, url string, erisim_zamani string, ham_metin string, icerik_hash string"


def snapshots(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """JSON documents below path, one in a file; broken files and records are left out."""
    read = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE")
    read = read.option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return read.json(path).where("_corrupt IS NULL").drop("_corrupt")


def own_links(pages: DataFrame) -> DataFrame:
    """page_id, link: distinct root-relative links of a page without query and fragment."""
    found = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)'), F.lit(1)))
    return pages.select("page_id", found.alias("link")).where("link NOT LIKE '//%'").distinct()
