"""All queries of the library over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.nulls import missing_fields
from ..operators import accuracy, history, offers, retrieval, selection
from ..operators.ranking import rank_nulls_last
from ..sources import raw
from . import surface, texts  # noqa: F401 (they register queries)
from .registry import QUERIES, SQL, postings_sql
from .registry import add as _query
from .registry import table as _table


@_query("""
    SELECT p_partkey, p_brand, nullif(p_size % 7, 0) AS rate, nullif(p_size % 5, 0) AS term,
      CAST(row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size % 7, 0) ASC NULLS LAST, p_partkey) AS INT) AS position,
      concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'rate' END, CASE WHEN p_size % 5 = 0 THEN 'term' END) AS missing
    FROM part""")
def rank_nulls_last_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "nullif(p_size % 7, 0) AS rate", "nullif(p_size % 5, 0) AS term")
    return rank_nulls_last(part, "rate", ["p_partkey"], within=["p_brand"]).withColumn("missing", missing_fields(["rate", "term"]))


QUERIES["rank_nulls_last"], SQL["rank_nulls_last"] = QUERIES.pop("rank_nulls_last_by_brand"), SQL.pop("rank_nulls_last_by_brand")


@_query("""
    WITH p AS (SELECT p_partkey, p_brand, nullif(p_size % 7, 0) AS rate, nullif(p_size % 5, 0) AS term, p_retailprice AS price FROM part),
    w AS (SELECT *, coalesce(rate = min(rate) OVER b, false)::INT + coalesce(term = max(term) OVER b, false)::INT
      + coalesce(price = min(price) OVER b, false)::INT AS wins FROM p WINDOW b AS (PARTITION BY p_brand)),
    m AS (SELECT *, max(wins) OVER (PARTITION BY p_brand) AS best FROM w)
    SELECT p_partkey, p_brand, rate, term, price, wins,
      wins = best AND best > 0 AND sum((wins = best)::INT) OVER (PARTITION BY p_brand) = 1 AS winner FROM m""")
def composite_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand", "nullif(p_size % 7, 0) AS rate", "nullif(p_size % 5, 0) AS term", "p_retailprice AS price"
    )
    return offers.composite_winners(part, "p_brand", {"rate": True, "term": False, "price": True})


@_query("""
    SELECT a.s_suppkey, a.s_nationkey, a.s_acctbal, CASE WHEN count(b.s_suppkey) > 1 THEN
      round((count(*) FILTER (b.s_acctbal > a.s_acctbal) + 0.5::DOUBLE * (count(*) FILTER (b.s_acctbal = a.s_acctbal) - 1)) / (count(*) - 1), 4) END AS percentile
    FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey GROUP BY ALL""")
def axis_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return offers.half_tie_percentile(supplier, "s_nationkey", "s_acctbal", low_is_better=True)


@_query("""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS s,
      CASE WHEN o_orderstatus <> 'F' THEN (o_orderdate + INTERVAL 90 DAY)::DATE END AS e FROM orders)
    SELECT o_orderkey, CASE WHEN e < DATE '1996-06-01' THEN 'EXPIRED' WHEN s > DATE '1996-06-01' THEN 'BILINMIYOR'
      WHEN e >= DATE '1996-06-01' THEN 'ACTIVE' WHEN s IS NOT NULL AND e IS NULL THEN 'ACTIVE' ELSE 'BILINMIYOR' END AS state FROM o""")
def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "IF(o_orderstatus <> 'P', CAST(o_orderdate AS DATE), NULL) AS s", "IF(o_orderstatus <> 'F', date_add(CAST(o_orderdate AS DATE), 90), NULL) AS e"
    )
    return orders.select("o_orderkey", offers.lifecycle("s", "e", F.lit("1996-06-01").cast("date")).alias("state"))


@_query("""
    WITH o AS (SELECT o_orderkey, o_totalprice AS p, (o_orderkey % 20) / 1000.0::DOUBLE AS r, CAST(6 + o_orderkey % 31 AS INT) AS n FROM orders)
    SELECT o_orderkey, round(CASE WHEN r = 0 THEN p / n ELSE p * r * pow(1 + r, n) / (pow(1 + r, n) - 1) END, 4) AS pay FROM o""")
def annuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice AS p", "CAST(o_orderkey % 20 AS DOUBLE) / 1000.0D AS r", "CAST(6 + o_orderkey % 31 AS INT) AS n"
    )
    return orders.select("o_orderkey", F.round(offers.instalment("p", "r", "n"), 4).alias("pay"))


@_query("""
    WITH RECURSIVE o AS (SELECT o_orderkey, o_totalprice AS p, (1 + o_orderkey % 20) / 1000.0::DOUBLE + 0.000317::DOUBLE AS r, CAST(6 + o_orderkey % 31 AS INT) AS n FROM orders),
    a AS (SELECT *, CASE WHEN r = 0 THEN p / n ELSE p * r * pow(1 + r, n) / (pow(1 + r, n) - 1) END AS pay FROM o),
    s AS (SELECT o_orderkey, r, n, pay, 1 AS month, p * r AS interest, pay - p * r AS repaid, p - (pay - p * r) AS balance FROM a UNION ALL
      SELECT o_orderkey, r, n, pay, month + 1, balance * r, CASE WHEN month + 1 = n THEN balance ELSE pay - balance * r END, CASE WHEN month + 1 = n THEN 0 ELSE balance - (pay - balance * r) END FROM s WHERE month < n)
    SELECT o_orderkey, month, round(interest, 0) AS interest, round(repaid, 0) AS repaid, abs(round(balance, 0)) AS balance FROM s""")
def amortisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice AS p", "CAST(1 + o_orderkey % 20 AS DOUBLE) / 1000.0D + 0.000317D AS r", "CAST(6 + o_orderkey % 31 AS INT) AS n"
    )
    return offers.schedule(orders, "p", "r", "n", digits=0).select("o_orderkey", "month", "interest", "repaid", F.abs("balance").alias("balance"))


@_query("""
    SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return history.latest(events, ["user_id", "event_type"], ["ts", "event_id"])


@_query("""
    SELECT user_id, event_type, count(*) AS versions, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
      arg_min(value, (ts, event_id)) IS DISTINCT FROM arg_max(value, (ts, event_id)) AS changed_value FROM events GROUP BY 1, 2""")
def first_last_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_and_last(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@_query("""
    SELECT sha256(trim(regexp_replace(lower(text), '[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies
    FROM documents GROUP BY 1""")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keep_first(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@_query("""
    WITH j AS (SELECT source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    f AS (SELECT source, count(*) AS total, 'quality' AS field, count(quality) AS filled FROM j GROUP BY 1
      UNION ALL SELECT source, count(*), 'toxic', count(toxic) FROM j GROUP BY 1)
    SELECT source, total, field, filled, round(filled * 100.0::DOUBLE / total, 1) AS percent FROM f""")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return history.fill_rates(joined, ["source"], ["quality", "toxic"])


@_query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def text_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return retrieval.containing(docs, items, "doc_id", "item_id", "text")


@_query("""
    SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS last_part FROM pages""")
def url_last_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), "([^/]*)$", 1).alias("last_part"))


@_query(f"WITH {postings_sql('documents', 'doc_id', 'd')} SELECT doc_id, term, tf FROM d")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(_table(spark, sf_dir, "documents"), "doc_id", "text")


_SPARSE = f"""{postings_sql('documents', 'doc_id', 'd')}, {postings_sql('benchmark', 'item_id', 'q')},
    i AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM d GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(q.tf * idf * d.tf), 6) AS score FROM q JOIN i USING (term) JOIN d USING (term) GROUP BY 1, 2)"""


@_query(f"""
    WITH {_SPARSE}
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS position FROM s
    QUALIFY position <= 5""")
def sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    asked = retrieval.postings(_table(spark, sf_dir, "benchmark"), "item_id", "text")
    return retrieval.sparse_search(asked, retrieval.postings(docs, "doc_id", "text"), "item_id", "doc_id", docs.agg(F.count(F.lit(1)).alias("n")), 5)


@_query("""SELECT count(*) AS n_rows, count(DISTINCT p_brand) AS n_brands, min(nullif(p_size % 7, 0)) AS least_rate FROM part""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_brand").alias("n_brands"), F.min(F.expr("nullif(p_size % 7, 0)")).alias("least_rate"))


@_query("""SELECT event_type, max(ts) AS newest, count(DISTINCT user_id) AS n_keys, count(*) AS n_rows FROM events GROUP BY 1""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.max("ts").alias("newest"), F.count_distinct("user_id").alias("n_keys"), F.count(F.lit(1)).alias("n_rows")
    )


_EDGE = r"[^\p{L}\p{N}_]"


def _masked_sql(text: str) -> str:
    """The masks one after the other; what stands around a number is kept, and every rule applied twice, as two finds may share a character."""
    alone = lambda x, body, label: rf"regexp_replace({x}, '(^|{_EDGE}){body}($|{_EDGE})', '\1{label}\2', 'g')"
    twice = lambda x, body, label: alone(alone(x, body, label), body, label)
    iban = twice(text, "[Tt][Rr] ?[0-9]{2}(?: ?[0-9]){22}", "[IBAN]")
    card = twice(iban, "[0-9](?:[ -]?[0-9]){15}", "[KART]")
    digit = lambda i: f"substr(m, {i}, 1)::INT"
    odd, even = (" + ".join(digit(i) for i in x) for x in ((1, 3, 5, 7, 9), (2, 4, 6, 8)))
    sound = f"(((7 * ({odd}) - ({even})) % 10 + 10) % 10 = {digit(10)} AND ({odd} + {even} + {digit(10)}) % 10 = {digit(11)})"
    known = f"list_filter(list_distinct(regexp_extract_all(c, '[1-9][0-9]{{10}}')), lambda m: {sound})"
    one = lambda x: rf"regexp_replace({x}, '(^|{_EDGE})' || m || '($|{_EDGE})', '\1[TCKN]\2', 'g')"
    identity = f"list_reduce(list_prepend(c, {known}), lambda t, m: {one(one('t'))})"
    email = rf"regexp_replace(i, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:[.][\p{{L}}\p{{N}}_-]+)+', '[EPOSTA]', 'g')"
    number = "[(]?5[0-9]{2}[)]?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}"
    prefixed = rf"regexp_replace({{x}}, '(?:[+]90[ -]?|0[ -]?){number}($|{_EDGE})', '[TELEFON]\1', 'g')"
    phone = twice(prefixed.replace("{x}", prefixed.replace("{x}", "e")), number, "[TELEFON]")
    return f"""c AS (SELECT doc_id, {card} AS c FROM documents), i AS (SELECT doc_id, {identity} AS i FROM c), e AS (SELECT doc_id, {email} AS e FROM i),
    p AS (SELECT doc_id, {phone} AS text FROM e)"""


@_query(f"WITH {_masked_sql('text')} SELECT doc_id, text FROM p")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.mask(F.col("text")).alias("text"))


@_query("""
    WITH p AS (SELECT p_partkey, p_type, nullif(p_size % 7, 0) AS rate, p_retailprice AS price FROM part),
    m AS (SELECT *, coalesce(rate = min(rate) OVER t, false) AS lead_rate, coalesce(price = min(price) OVER t, false) AS lead_price FROM p WINDOW t AS (PARTITION BY p_type))
    SELECT *, lead_rate::INT + lead_price::INT AS n_leads FROM m""")
def competitor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", "nullif(p_size % 7, 0) AS rate", "p_retailprice AS price")
    return offers.competitor_matrix(part, "p_type", {"rate": True, "price": True})


_PERCENTILE = """(SELECT CASE WHEN count({c}) > 1 THEN round((count(*) FILTER (b.{c} {worse} a.{c}) + 0.5::DOUBLE * (count(*) FILTER (b.{c} = a.{c}) - 1))
      / (count({c}) - 1), 4) END FROM p b WHERE b.p_type = a.p_type)"""


@_query(f"""
    WITH p AS (SELECT p_partkey, p_type, nullif(p_size % 7, 0) AS rate, p_size AS size, p_retailprice AS price FROM part),
    n AS (SELECT p_type, count(*) AS peers FROM p GROUP BY 1),
    q AS (SELECT p_partkey, peers, CASE WHEN rate IS NOT NULL THEN {_PERCENTILE.format(c="rate", worse=">")} END AS x,
      {_PERCENTILE.format(c="size", worse="<")} AS y, {_PERCENTILE.format(c="price", worse=">")} AS z FROM p a JOIN n USING (p_type)),
    k AS (SELECT *, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (z IS NOT NULL)::INT AS known FROM q)
    SELECT p_partkey, CASE WHEN peers >= 3 AND known >= 2 THEN round((coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0)) / known, 6) END AS score FROM k""")
def financial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", "nullif(p_size % 7, 0) AS rate", "p_size AS size", "p_retailprice AS price")
    return offers.financial_score(part, "p_type", {"rate": True, "size": False, "price": True}, digits=6).select("p_partkey", "score")


@_query("""
    WITH o AS (SELECT o_orderkey, o_totalprice / 100 AS a, (o_orderkey % 20) / 1000.0::DOUBLE AS r, CAST(6 + o_orderkey % 31 AS INT) AS n FROM orders)
    SELECT o_orderkey, round(CASE WHEN r = 0 THEN a * n ELSE a * (pow(1 + r, n) - 1) / (r * pow(1 + r, n)) END, 4) AS principal FROM o""")
def inverse_annuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice / 100 AS a", "CAST(o_orderkey % 20 AS DOUBLE) / 1000.0D AS r", "CAST(6 + o_orderkey % 31 AS INT) AS n"
    )
    return orders.select("o_orderkey", F.round(offers.affordable_principal("a", "r", "n"), 4).alias("principal"))


@_query("""
    WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS p, (o_orderkey % 20) / 1000.0::DOUBLE AS r, CAST(6 + o_orderkey % 31 AS INT) AS n FROM orders),
    t AS (SELECT o_custkey, o_orderkey, round(n * CASE WHEN r = 0 THEN p / n ELSE p * r * pow(1 + r, n) / (pow(1 + r, n) - 1) END, 4) AS total FROM o)
    SELECT o_custkey, arg_min(o_orderkey, (total, o_orderkey)) AS o_orderkey, min(total) AS total FROM t GROUP BY 1""")
def cheapest_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey", "o_totalprice AS p", "CAST(o_orderkey % 20 AS DOUBLE) / 1000.0D AS r", "CAST(6 + o_orderkey % 31 AS INT) AS n"
    )
    return offers.cheapest(orders.withColumn("total", F.round(F.col("n") * offers.instalment("p", "r", "n"), 4)), "o_custkey", "o_orderkey", "total")


@_query("""
    SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER u AS before, row_number() OVER u AS k FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE k = 1 OR event_type IS DISTINCT FROM before""")
def delta_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return history.changes(events, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@_query("""
    SELECT event_type, CAST(sum(n) AS BIGINT) AS snapshots, count(*) AS n_keys, round(avg(n), 4) AS mean_versions, count(*) FILTER (n > 1) AS several
    FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.version_stats(_table(spark, sf_dir, "events"), ["event_type"], ["user_id"])


@_query("""
    SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first""")
def cross_url_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicates(_table(spark, sf_dir, "documents"), "text", "doc_id")


@_query("""
    SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS n_left, coalesce(s.n, 0) AS n_right FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def bank_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return history.both_axes(customers, _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


_GUESS = "CASE WHEN n_chars >= 1000 THEN 1 WHEN n_chars >= 200 THEN 0 END"


@_query(f"""
    WITH j AS (SELECT quality, toxic, {_GUESS} AS guess FROM documents LEFT JOIN labels USING (doc_id)),
    l AS (SELECT 'quality' AS field, quality AS g, guess AS p FROM j UNION ALL SELECT 'toxic', toxic, guess FROM j),
    c AS (SELECT field, count(*) FILTER (g = p) AS correct, count(*) FILTER (g <> p) AS wrong, count(*) FILTER (g IS NOT NULL AND p IS NULL) AS missed,
      count(*) FILTER (g IS NULL AND p IS NOT NULL) AS invented, count(*) FILTER (g IS NULL AND p IS NULL) AS correct_empty FROM l GROUP BY 1),
    m AS (SELECT *, correct::DOUBLE / nullif(correct + wrong + invented, 0) AS a, correct::DOUBLE / nullif(correct + wrong + missed, 0) AS b FROM c)
    SELECT field, correct, wrong, missed, invented, correct_empty, round(100 * a, 6) AS precision, round(100 * b, 6) AS recall,
      round(100 * CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) WHEN a + b = 0 THEN 0 END, 6) AS f1 FROM m""")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_GUESS).alias("guess"))
    joined = docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return accuracy.precision_recall(accuracy.confusion(joined, {"quality": ("quality", "guess"), "toxic": ("toxic", "guess")}), 6)


@_query("""
    SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS turn FROM documents
    QUALIFY turn <= 5 ORDER BY turn, source NULLS LAST, doc_id LIMIT 20""")
def quota_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin(_table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5, 20)


@_query("""
    WITH d AS (SELECT DISTINCT source, doc_id FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM d)
    SELECT source, doc_id, CASE WHEN n >= 3 AND k <= greatest(1, round_even(0.2::DOUBLE * n, 0)) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stratified_split(_table(spark, sf_dir, "documents"), "source", "doc_id")


@_query("""
    WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), l AS (SELECT p_type FROM s ORDER BY n DESC, p_type LIMIT 5)
    SELECT coalesce(l.p_type, 'other') AS p_type, CAST(sum(n) AS BIGINT) AS n FROM s LEFT JOIN l ON s.p_type = l.p_type GROUP BY 1""")
def top5_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.leading_groups(_table(spark, sf_dir, "part"), "p_type", 5, "other")


@_query("""SELECT coalesce(event_type, 'UNCLASSIFIED') AS theme, count(*) AS n FROM events GROUP BY 1""")
def theme_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("UNCLASSIFIED")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))


@_query("""
    WITH h AS (SELECT p_partkey, contains(p_name, '1')::INT + contains(p_name, '2')::INT AS a, contains(p_name, '3')::INT + contains(p_name, '4')::INT AS b FROM part)
    SELECT p_partkey, CASE WHEN a >= b AND a > 0 THEN 'low' WHEN b > 0 THEN 'high' END AS name, nullif(greatest(a, b), 0) AS hits FROM h""")
def keyword_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.keyword_class(F.col("p_name"), {"low": ["1", "2"], "high": ["3", "4"]})
    return _table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.name", "x.hits")


@_query("""
    SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'blank' END,
      CASE WHEN length(coalesce(text, '')) < 150 THEN 'short' END, CASE WHEN contains(coalesce(text, ''), chr(65533)) OR contains(coalesce(text, ''), chr(195)) THEN 'garbled' END,
      CASE WHEN NOT regexp_matches(lower(coalesce(text, '')), 'ing|ung|ment|ción') THEN 'off_topic' END) AS problems,
      length(coalesce(text, '')) BETWEEN 150 AND 999 AS brief FROM documents""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", T.problems(text, words=("ing", "ung", "ment", "ción")).alias("problems"), F.length(text).between(150, 999).alias("brief"))


@_query("""
    SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)', 1)) AS link FROM pages) WHERE link NOT LIKE '//%'""")
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.own_links(_table(spark, sf_dir, "pages"))


@_query("""SELECT DISTINCT p_brand FROM part""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_brand").distinct()


@_query()
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.packed_lines(F.col("text"))).alias("position", "chunk"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
