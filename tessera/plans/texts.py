"""Queries over the given texts and pages, with SQL over the same texts; the catalogue holds them with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numerals
from ..functions import text as T
from ..functions.text import FOLD_FROM, FOLD_TO
from ..operators import accuracy, retrieval, verification
from ..operators.durable import stored
from ..sources import tables
from .registry import add, postings_sql, table

_W = r"\p{L}\p{N}_.,․"
#: Numbers of documents as a common table expression: runs of letters, digits and signs with their places; a number alone is a run of its own.
_NUMBERS = rf"""
    folded AS (SELECT doc_id, regexp_replace(regexp_replace(translate(lower(replace(text, 'İ', 'i')), '{FOLD_FROM}', '{FOLD_TO}'),
      '([0-9])[.]([0-9])', '\1․\2', 'g'), '([0-9])[.]([0-9])', '\1․\2', 'g') AS t FROM documents),
    runs AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '[{_W}]+|[^{_W}]+')) AS run, generate_subscripts(regexp_extract_all(t, '[{_W}]+|[^{_W}]+'), 1) AS i FROM folded),
    placed AS (SELECT *, 1 + sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS position FROM runs),
    alone AS (SELECT doc_id, t, position, rtrim(run, '.,') AS w, length(rtrim(run, '.,')) AS n FROM placed WHERE regexp_matches(run, '^[0-9]+([․,][0-9]+)*[.,]*$')),
    beside AS (SELECT *, substr(t, greatest(1, position - 60)::BIGINT, least(60, position - 1)::BIGINT) AS before, substr(t, (position + n)::BIGINT, 60) AS after FROM alone WHERE n <= 40),
    readings AS (
      SELECT *, replace(replace(w, '․', ''), ',', '')::DOUBLE AS value, true AS whole FROM beside
      WHERE regexp_matches(w, '^(0|[1-9][0-9]*)$') OR regexp_matches(w, '^[1-9][0-9]{{0,2}}((․[0-9]{{3}})+|(,[0-9]{{3}})+)$')
      UNION ALL SELECT *, replace(replace(w, '․', '.'), ',', '.')::DOUBLE, false FROM beside WHERE regexp_matches(w, '^(0|[1-9][0-9]*)[․,][0-9]{{0,3}}[1-9]$')
      UNION ALL SELECT *, w::DOUBLE * 1000, true FROM beside WHERE regexp_matches(w, '^(0|[1-9][0-9]*)$') AND regexp_matches(after, '^\s*bin([^\p{{L}}\p{{N}}_]|$)')),
    numbers AS (SELECT doc_id, position::INT AS position, replace(w, '․', '.') AS written, value, whole,
      replace(regexp_extract(before, '[^.!?]*$') || w || regexp_extract(after, '^[^.!?]*'), '․', '.') AS sentence FROM readings)"""


@add(f"WITH {_NUMBERS} SELECT * FROM numbers")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every document with its place, value and sentence: the evidence that a labeller or a check looks at."""
    return numerals.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text")


_CLAIMS = """SELECT doc_id, 'phone' AS field, CASE doc_id % 4 WHEN 0 THEN 555 WHEN 1 THEN 554.6 WHEN 2 THEN 5.55 END::DOUBLE AS claimed FROM documents
    UNION ALL SELECT doc_id, 'list', 1 + doc_id % 3 + 0.0::DOUBLE FROM documents UNION ALL SELECT doc_id, 'other', (doc_id % 1000)::DOUBLE FROM documents
    UNION ALL SELECT doc_id, 'version', 2 + doc_id % 2 * 0.04::DOUBLE FROM documents"""
_CLAIM_WORDS = {"phone": ("+1 (", "tel"), "list": ("the", "de"), "version": ("version", "lizenz")}
_NEAR = " ".join(f"WHEN field = '{f}' THEN " + " OR ".join(f"contains(sentence, '{w}')" for w in words) for f, words in _CLAIM_WORDS.items())


@add(f"""
    WITH {_NUMBERS}, claims AS ({_CLAIMS}), each AS (SELECT row_number() OVER () AS id, * FROM claims),
    meant AS (SELECT *, CASE WHEN field = 'list' THEN [round_even(claimed, 0)] ELSE [round_even(claimed, 4), round_even(claimed, 2), round_even(claimed, 1), round_even(claimed, 0)] END AS forms FROM each),
    met AS (SELECT m.id, bool_or(n.doc_id IS NOT NULL) AS found, bool_or(n.doc_id IS NOT NULL AND (CASE {_NEAR} ELSE true END)) AS confirmed
      FROM meant m LEFT JOIN numbers n ON n.doc_id = m.doc_id AND list_contains(m.forms, n.value) AND (n.whole OR field <> 'list') GROUP BY m.id)
    SELECT doc_id, field, claimed, CASE WHEN claimed IS NOT NULL THEN found END AS found, CASE WHEN claimed IS NOT NULL THEN confirmed END AS confirmed FROM each JOIN met USING (id)""")
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four claims about every document against the numbers that it holds and the words near them."""
    docs = table(spark, sf_dir, "documents")
    part = lambda field, e: docs.select("doc_id", F.lit(field).alias("field"), F.expr(e).cast("double").alias("claimed"))
    claims = part("phone", "CASE doc_id % 4 WHEN 0 THEN 555 WHEN 1 THEN 554.6 WHEN 2 THEN 5.55 END")
    for field, e in (("list", "1 + doc_id % 3"), ("other", "doc_id % 1000"), ("version", "2 + doc_id % 2 * 0.04D")):
        claims = claims.unionByName(part(field, e))
    return verification.verify(claims, numerals.occurrences(docs, "doc_id", "text"), "doc_id", "field", "claimed", _CLAIM_WORDS, ("list",))


_WANTED = "label % 3 = 1"


@add(f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND e.{_WANTED})
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS position FROM s QUALIFY position <= 5""")
def filtered_dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest among vectors with a payload that fits, which are picked before anything is compared."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.dense_search(asked, vectors, "query_id", "vec_id", 5, payload=F.expr(_WANTED))
    return found.withColumn("score", F.round("score", 6))


_DIGITS = "list_transform(range(1, 17), lambda i: (('0x' || substr(md5(term), i, 1))::INT - 7.5)::DOUBLE)"


def _hashed_sql(name: str, key: str) -> str:
    return f"""(SELECT {key}, list(x ORDER BY i) AS v FROM (SELECT {key}, i, sum(tf * c) AS x FROM (
        SELECT {key}, tf, unnest(range(16)) AS i, unnest({_DIGITS}) AS c FROM {name}) GROUP BY 1, 2) GROUP BY 1)"""


def _ranked_sql(scores: str, name: str, k: int) -> str:
    return f"SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS {name} FROM {scores} QUALIFY {name} <= {k}"


@add(f"""
    WITH {postings_sql('documents', 'doc_id', 'd')}, {postings_sql('benchmark', 'item_id', 'q')},
    i AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM d GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(q.tf * idf * d.tf), 6) AS score FROM q JOIN i USING (term) JOIN d USING (term) GROUP BY 1, 2),
    n AS (SELECT a.item_id, b.doc_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM {_hashed_sql('q', 'item_id')} a, {_hashed_sql('d', 'doc_id')} b),
    x AS ({_ranked_sql('s', 'a', 20)}), y AS ({_ranked_sql('n', 'b', 20)}),
    f AS (SELECT item_id, doc_id, round(coalesce(1 / (60 + a)::DOUBLE, 0) + coalesce(1 / (60 + b)::DOUBLE, 0), 8) AS score FROM x FULL JOIN y USING (item_id, doc_id))
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS position FROM f QUALIFY position <= 5""")
def hybrid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for every item of the benchmark: a sparse and a dense list of twenty, fused; vectors are hashed terms, for want of a model."""
    docs = table(spark, sf_dir, "documents")
    held, asked = (retrieval.postings(df, key, "text") for df, key in ((docs, "doc_id"), (table(spark, sf_dir, "benchmark"), "item_id")))
    held = stored(held)  # three passes read them
    sparse = retrieval.sparse_search(asked, held, "item_id", "doc_id", docs.agg(F.count(F.lit(1)).alias("n")), 20)
    dense = retrieval.dense_search(retrieval.hashed_vectors(asked, "item_id"), stored(retrieval.hashed_vectors(held, "doc_id")), "item_id", "doc_id", 20)
    return retrieval.fuse(sparse, dense, "item_id", "doc_id", 5)


@add(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS t, regexp_extract(html, '(?s)</h1>(.*)$', 1) AS b FROM pages WHERE contains(html, '</h1>')),
    d AS (SELECT page_id, url, regexp_replace(t, '<[^>]*>', '', 'g') AS t, regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS b FROM p),
    u AS (SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) FOR x IN [t, b]] AS x FROM d)
    SELECT page_id, x[1] AS title, length(x[2]) AS n_chars, md5(x[2]) AS body_md5 FROM u""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's headings with the text up to the next, by the page's tree."""
    pages = table(spark, sf_dir, "pages")
    parts = tables.sections(pages, "page_id", "url", "html")
    return parts.select("page_id", "title", F.length("body").cast("long").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@add("""
    WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
    n AS (SELECT *, CASE WHEN regexp_matches(lower(host), '[.](com|org|net|gov|edu|co|ac)[.][a-z]{2}$') THEN array_to_string(string_split(lower(host), '.')[-3:], '.')
      ELSE array_to_string(string_split(lower(host), '.')[-2:], '.') END AS site FROM h)
    SELECT a.page_id, b.host AS other, a.host <> '' AND b.host <> '' AND (lower(a.host) = lower(b.host) OR ends_with(lower(b.host), '.' || a.site)) AS same_site
    FROM n a JOIN n b ON b.page_id = a.page_id + 1""")
def neighbouring_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page and the next, whether the next may be followed from the first: one site, or hosts below its name."""
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    after = hosts.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("other"))
    return hosts.join(after, "page_id").select("page_id", "other", T.same_site(F.col("host"), F.col("other")).alias("same_site"))


_SPOKEN = "CASE WHEN text LIKE '%ción%' THEN 'es' WHEN text LIKE '%ung%' OR text LIKE '%keit%' THEN 'de' WHEN text LIKE '%eau%' THEN 'fr' WHEN text LIKE '%ing%' THEN 'en' END"


@add(f"""
    WITH j AS (SELECT lang, n_chars, quality, length(text) - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS n, {_SPOKEN} AS spoken, CASE WHEN length(text) >= 600 THEN 1 WHEN length(text) >= 100 THEN 0 END AS good,
        doc_id % 2 = 0 AS unstated FROM documents LEFT JOIN labels USING (doc_id)),
    o AS (
      SELECT 'lang' AS field, lang IS NULL AS g0, spoken IS NULL AS p0, lang = spoken AS same, false AS known FROM j
      UNION ALL SELECT 'n_chars', n_chars IS NULL, n IS NULL, abs(n_chars - n) <= 0.01, false FROM j UNION ALL SELECT 'quality', quality IS NULL, good IS NULL, quality = good, unstated FROM j),
    c AS (SELECT field, count(*) FILTER (NOT g0 AND NOT p0 AND same) AS correct, count(*) FILTER (NOT g0 AND NOT p0 AND NOT same) AS wrong, count(*) FILTER (NOT g0 AND p0) AS missed,
      count(*) FILTER (g0 AND known AND NOT p0) AS invented, count(*) FILTER (g0 AND known AND p0) AS correct_empty FROM o GROUP BY 1),
    a AS (SELECT * FROM c UNION ALL SELECT NULL, sum(correct)::BIGINT, sum(wrong)::BIGINT, sum(missed)::BIGINT, sum(invented)::BIGINT, sum(correct_empty)::BIGINT FROM c),
    m AS (SELECT *, correct::DOUBLE / nullif(correct + wrong + invented, 0) AS p, correct::DOUBLE / nullif(correct + wrong + missed, 0) AS r FROM a),
    f AS (SELECT *, round(100 * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p + r = 0 THEN 0 END, 4) AS own FROM m)
    SELECT field, correct, wrong, missed, invented, correct_empty, round(100 * p, 4) AS precision, round(100 * r, 4) AS recall,
      CASE WHEN field IS NULL THEN (SELECT round(avg(own), 4) FROM f WHERE field IS NOT NULL) ELSE own END AS f1 FROM f""")
def field_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor of three fields of different kinds against what tables say, with fields whose gold may be known to be empty."""
    gold = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    gold = gold.withColumn("unstated", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("quality"))))

    def extractor(df: DataFrame) -> DataFrame:
        n = F.length("text")
        return df.withColumns({"n": n - F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0), "spoken": F.expr(_SPOKEN), "good": F.when(n >= 600, 1).when(n >= 100, 0)})

    return accuracy.evaluate(gold, extractor, {"lang": ("lang", "spoken"), "n_chars": ("n_chars", "n"), "quality": ("quality", "good")}, "unstated", digits=4)
