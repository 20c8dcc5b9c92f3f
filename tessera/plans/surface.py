"""Queries of comparing, covering, matching and extracting, with their SQL; the catalogue holds them with the others."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extraction, numbers
from ..functions import text as T
from ..operators import answers, compare, complaints, history, matching, offers, questions, retrieval, verification
from ..sources import tables
from ..streaming import sinks
from .registry import add, table

_PART = "SELECT p_partkey, p_brand, p_type, concat('u', p_size % 3) AS unit, nullif(p_size % 7, 0) AS rate, nullif(p_size % 5, 0) AS term, p_retailprice AS price FROM part"
_AXES = {"rate": True, "term": False, "price": True}


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand", "p_type", "concat('u', p_size % 3) AS unit", "nullif(p_size % 7, 0) AS rate", "nullif(p_size % 5, 0) AS term", "p_retailprice AS price"
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys of orders, k, dealt to as many tasks as a shuffle has: few bytes, but much work each, so they aren't put together again."""
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k")
    return keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").distinct()


@add(f"SELECT * FROM ({_PART}) WHERE p_brand = 'Brand#1' OR p_brand = 'Brand#13'")
def offers_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    return compare.offers_of(part, "p_partkey", p_brand="Brand#1", p_type=None).unionByName(compare.offers_of(part, "p_partkey", p_brand="Brand#13"))


@add(f"SELECT * FROM ({_PART}) WHERE p_partkey = 7")
def offer_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).where("p_partkey = 7")


@add(f"SELECT * FROM ({_PART}) WHERE price > 900 ORDER BY rate ASC NULLS LAST, p_partkey LIMIT 10")
def ranked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ranked_by(_part(spark, sf_dir).where("price > 900"), _AXES, "rate", "p_partkey")


@add(f"SELECT p_partkey, term FROM ({_PART}) WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY term DESC NULLS LAST, p_partkey LIMIT 5")
def criterion_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    part.withColumnRenamed("p_brand", "kind").createOrReplaceTempView("tessera_offers")
    kind = part.agg(F.min("p_brand")).first()[0]
    return spark.sql(compare.criterion_sql("tessera_offers", ["p_partkey", "term"], _AXES, "term", "p_partkey"), args={"kind": kind, "n": 5})


@add(f"SELECT p_partkey, coalesce(rate, 0) AS rate, coalesce(CASE WHEN term > 2 THEN 'long' END, 'unknown') AS state FROM ({_PART})")
def defaults_for_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", F.coalesce("rate", F.lit(0)).alias("rate"), F.coalesce(F.when(F.col("term") > 2, "long"), F.lit("unknown")).alias("state"))


_WINS = f"""w AS (SELECT *, coalesce(rate = min(rate) OVER b, false)::INT + coalesce(term = max(term) OVER b, false)::INT + coalesce(price = min(price) OVER b, false)::INT AS wins
    FROM ({_PART}) WINDOW b AS (PARTITION BY p_brand))"""


@add(f"WITH {_WINS} SELECT p_partkey, wins FROM w ORDER BY wins DESC, p_partkey LIMIT 20")
def sorted_by_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.composite_winners(_part(spark, sf_dir), "p_brand", _AXES).orderBy(F.desc("wins"), "p_partkey").select("p_partkey", "wins").limit(20)


@add(f"""
    WITH m AS (SELECT *, coalesce(rate = min(rate) OVER t, false) AS lead_rate, coalesce(price = min(price) OVER t, false) AS lead_price FROM ({_PART}) WINDOW t AS (PARTITION BY p_type))
    SELECT p_partkey, p_brand, lead_rate::INT + lead_price::INT AS n_leads FROM m ORDER BY n_leads DESC, p_brand, p_partkey LIMIT 50""")
def sorted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.sorted_matrix(_part(spark, sf_dir), "p_type", {"rate": True, "price": True}, ["p_brand", "p_partkey"]).select("p_partkey", "p_brand", "n_leads").limit(50)


_LOAN = "SELECT o_orderkey, o_custkey, o_totalprice AS p, (o_orderkey % 20) / 1000.0::DOUBLE AS r, CAST(6 + o_orderkey % 31 AS INT) AS n FROM orders"
_PAY = f"SELECT *, CASE WHEN r = 0 THEN p / n ELSE p * r * pow(1 + r, n) / (pow(1 + r, n) - 1) END AS raw FROM ({_LOAN})"


def _loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice AS p", "CAST(o_orderkey % 20 AS DOUBLE) / 1000.0D AS r", "CAST(6 + o_orderkey % 31 AS INT) AS n"
    )
    return orders.withColumn("pay", offers.instalment("p", "r", "n"))


@add(f"""
    SELECT o_orderkey, round(raw * n, 4) AS total, round(raw * n - p, 4) AS profit FROM ({_PAY})""")
def annuity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loans(spark, sf_dir).select("o_orderkey", F.round(F.col("pay") * F.col("n"), 4).alias("total"), F.round(F.col("pay") * F.col("n") - F.col("p"), 4).alias("profit"))


@add(f"SELECT o_orderkey, round(raw * n, 4) AS total FROM ({_PAY}) ORDER BY total, o_orderkey LIMIT 20")
def total_cost_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loans(spark, sf_dir).select("o_orderkey", F.round(F.col("pay") * F.col("n"), 4).alias("total")).orderBy("total", "o_orderkey").limit(20)


@add(f"""SELECT o_custkey, arg_min(o_orderkey, (round(raw * n, 4), o_orderkey)) AS least_total, arg_min(o_orderkey, (round(raw, 4), o_orderkey)) AS least_pay,
      least_total <> least_pay AS they_differ FROM ({_PAY}) GROUP BY 1""")
def cheapest_two_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = _loans(spark, sf_dir)
    by = lambda c: F.min_by("o_orderkey", F.struct(F.round(c, 4), "o_orderkey"))
    out = loans.groupBy("o_custkey").agg(by(F.col("pay") * F.col("n")).alias("least_total"), by(F.col("pay")).alias("least_pay"))
    return out.withColumn("they_differ", F.col("least_total") != F.col("least_pay"))


@add(f"SELECT p.*, position FROM ({_PART}) p JOIN (VALUES (9, 0), (3, 1), (999999999, 2), (5, 3)) v(k, position) ON k = p_partkey")
def picked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.in_given_order(_part(spark, sf_dir), "p_partkey", [9, 3, 999999999, 5])


@add(f"""
    SELECT p_partkey, CASE WHEN term IS NULL THEN 1 ELSE 1 + count(*) FILTER (rate IS NOT NULL) OVER (PARTITION BY term) - (rate IS NOT NULL)::INT END AS peers FROM ({_PART})""")
def peer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.with_peers(_part(spark, sf_dir), "p_partkey", "term", F.col("rate").isNotNull()).select("p_partkey", F.col("peers").cast("long").alias("peers"))


@add(f"""
    WITH k AS (SELECT p_partkey, rate, count(rate) OVER t AS n, min(unit) OVER t <> max(unit) OVER t AND p_partkey % 3 = 0 AS mixed FROM ({_PART}) WINDOW t AS (PARTITION BY p_type, p_brand))
    SELECT p_partkey, CASE WHEN rate IS NULL THEN 'deger_yok' WHEN mixed THEN 'birim_karisik' WHEN n < 2 THEN 'yetersiz_eksen_kume' END AS state FROM k""")
def axis_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).withColumn("g", F.concat_ws("|", "p_type", "p_brand"))
    facts = offers.beside_group(part, "g", n=F.count("rate"), low=F.min("unit"), high=F.max("unit"))
    return facts.select("p_partkey", compare.axis_state(F.col("rate"), F.col("n"), (F.col("low") != F.col("high")) & (F.col("p_partkey") % 3 == 0)).alias("state"))


@add(f"SELECT p_type, count(*) AS n_rows, count(DISTINCT p_brand) AS n_who, count(rate) AS n_rate, count(term) AS n_term FROM ({_PART}) GROUP BY 1")
def matrix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.matrix_counts(_part(spark, sf_dir), "p_type", "p_brand", ["rate", "term"])


@add(f"""
    SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 4 = 0 THEN 'no single leader' ELSE concat('leader ', p_brand) END, concat('rate: ', coalesce(rate::VARCHAR, '-')),
      concat('term: ', coalesce(term::VARCHAR, '-')), CASE WHEN rate IS NULL OR term IS NULL THEN concat((rate IS NULL)::INT + (term IS NULL)::INT, ' missing') END) AS why FROM ({_PART})""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.col("rate").isNull().cast("int") + F.col("term").isNull().cast("int")
    why = compare.explanation(F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), missing, [("rate", F.col("rate")), ("term", F.col("term"))])
    return _part(spark, sf_dir).select("p_partkey", why.alias("why"))


@add(f"SELECT p_partkey, nullif(concat_ws(', ', 'rate ' || rate, 'term ' || term), '') AS summary FROM ({_PART})")
def advantage_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c: F.concat(F.lit(f"{c} "), F.col(c).cast("string"))
    return _part(spark, sf_dir).select("p_partkey", compare.summary(known("rate"), known("term")).alias("summary"))


@add(f"SELECT p_brand, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(rate, p_partkey) AS rate, arg_min(term, p_partkey) AS term FROM ({_PART}) WHERE rate IS NOT NULL AND term IS NOT NULL GROUP BY 1")
def first_qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.first_qualifying(_part(spark, sf_dir).select("p_brand", "p_partkey", "rate", "term"), "p_brand", "p_partkey", ["rate", "term"])


@add("""
    SELECT min(a) AS first_day, max(b) AS last_day, round(avg(n), 2) AS mean_versions, count(*) FILTER (n > 1) AS several, CAST(greatest(0, DATE '2030-01-01' - max(b)) AS INT) AS stale_days
    FROM (SELECT count(*) AS n, min(ts::DATE) AS a, max(ts::DATE) AS b FROM events GROUP BY user_id, event_type)""")
def coverage_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return compare.coverage_time(events, ["user_id", "event_type"], "day", F.lit("2030-01-01").cast("date"))


@add(f"""
    SELECT p_partkey, concat_ws(',', CASE WHEN rate IS NOT NULL AND term IS NULL THEN 'rate_without_term' END, CASE WHEN rate * 5 > 20 THEN 'rate_above_20' END,
      CASE WHEN p_partkey % 11 = 0 THEN 'reward_without_unit' END, CASE WHEN p_partkey % 13 = 0 THEN 'no_url' END) AS names FROM ({_PART})""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    reward = F.when(F.col("p_partkey") % 11 == 0, F.lit(5.0))
    found = compare.contradictions(F.when(F.col("term").isNull() | (F.col("rate") * 5 <= 20), F.when(F.col("term").isNull() & (F.col("rate") * 5 > 20), F.lit(25.0)).otherwise(F.col("rate"))).otherwise(F.col("rate") * 5.0),
                                   F.col("term"), none.cast("string"), reward, none.cast("date"), none.cast("date"), F.when(F.col("p_partkey") % 13 != 0, F.lit("u")))
    return _part(spark, sf_dir).select("p_partkey", F.concat_ws(",", found).alias("names"))


@add("SELECT user_id, event_type, ts, value, event_id, CAST(row_number() OVER (w ORDER BY ts, event_id) AS INT) AS version, count(*) OVER w AS of FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def history_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.history_list(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@add(f"SELECT p_brand, count(DISTINCT coalesce(nullif(trim(unit), ''), '?')) <= 1 AS one_unit, count(*) AS n FROM ({_PART}) WHERE rate IS NOT NULL GROUP BY 1")
def unit_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("?"))
    return _part(spark, sf_dir).where("rate IS NOT NULL").groupBy("p_brand").agg((F.count_distinct(unit) <= 1).alias("one_unit"), F.count(F.lit(1)).alias("n"))


@add("SELECT lang, round(avg(quality), 4) AS mean_quality, round(avg((toxic = 1)::INT), 4) AS toxic_share FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("mean_quality"), F.round(F.avg((F.col("toxic") == 1).cast("int")), 4).alias("toxic_share"))


@add("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON n_nationkey = c_nationkey")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select("n_nationkey", "n_name")
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(names), F.col("n_nationkey") == F.col("c_nationkey"), "left")  # a table of nations is small by nature
    return joined.select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nation"))


@add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@add("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@add("""
    SELECT c_custkey, o_orderkey, o_orderkey IS NULL AS without FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def latest_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = history.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "o_orderkey", F.col("o_orderkey").isNull().alias("without"))


@add(f"SELECT p_partkey, first FROM ({_PART}) LEFT JOIN (SELECT p_brand, p_type, min(p_partkey) AS first FROM ({_PART}) WHERE rate IS NOT NULL GROUP BY 1, 2) USING (p_brand, p_type)")
def lookup_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    first = part.where("rate IS NOT NULL").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    return part.join(first, ["p_brand", "p_type"], "left").select("p_partkey", "first")


@add("""
    WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 20), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
    SELECT 'both' AS kind, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'common', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
    UNION ALL SELECT 'left', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, name: df.select(F.lit(name).alias("kind"), "k")
    return named(c.union(s).distinct(), "both").union(named(c.intersect(s), "common")).union(named(c.subtract(s), "left"))


@add("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names, count(DISTINCT p_type) AS n FROM part GROUP BY 1")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return pairs.groupBy("p_brand").agg(F.concat_ws(",", F.array_sort(F.collect_set("p_type"))).alias("names"), F.count("p_type").alias("n"))


@add(f"SELECT p_partkey, coalesce(rate, 999) AS rate_key FROM ({_PART}) ORDER BY rate_key, p_partkey LIMIT 30")
def nulls_as_999(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", F.coalesce("rate", F.lit(999)).alias("rate_key")).orderBy("rate_key", "p_partkey").limit(30)


@add("SELECT split_part(p_type, ' ', 1) AS family, count(*) AS n FROM part GROUP BY 1")
def counts_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.substring_index("p_type", " ", 1).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@add("""
    SELECT lower(trim(event_type)) AS question, string_agg(DISTINCT (user_id % 10)::VARCHAR, ',' ORDER BY (user_id % 10)::VARCHAR) AS answers FROM events GROUP BY 1""")
def merged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select(F.lower(F.trim("event_type")).alias("question"), (F.col("user_id") % 10).cast("string").alias("a")).distinct()
    return pairs.groupBy("question").agg(F.concat_ws(",", F.array_sort(F.collect_set("a"))).alias("answers"))


@add("""
    SELECT lang, count(*) AS n, count(quality) AS with_quality, count(toxic) AS with_toxic, count(DISTINCT source) AS n_sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("with_quality"), F.count("toxic").alias("with_toxic"), F.count_distinct("source").alias("n_sources"))


@add("""
    WITH c AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size % 3 END AS rv, p_size % 10 / 10.0::DOUBLE AS rc, CASE WHEN p_size % 5 > 0 THEN p_size % 2 END AS nv, 0.7::DOUBLE AS nc FROM part)
    SELECT p_partkey, CASE WHEN rv IS NULL OR (nv IS NOT NULL AND rc < 0.8 AND nc > rc) THEN nv ELSE rv END::DOUBLE AS value,
      CASE WHEN rv IS NULL OR (nv IS NOT NULL AND rc < 0.8 AND nc > rc) THEN 'ner' ELSE 'regex' END AS layer, coalesce(rv <> nv, false) AS conflict
    FROM c WHERE rv IS NOT NULL OR nv IS NOT NULL""")
def reconciled_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    regex = part.selectExpr("p_partkey", "'rate' AS field", "'regex' AS layer", "CAST(IF(p_size % 4 > 0, p_size % 3, NULL) AS DOUBLE) AS value", "CAST(p_size % 10 AS DOUBLE) / 10 AS confidence")
    ner = part.selectExpr("p_partkey", "'rate' AS field", "'ner' AS layer", "CAST(IF(p_size % 5 > 0, p_size % 2, NULL) AS DOUBLE) AS value", "0.7D AS confidence")
    return verification.reconcile(regex.unionByName(ner), ["p_partkey"], ["regex", "ner", "llm"]).select("p_partkey", "value", "layer", "conflict")


@add("""
    WITH c AS (SELECT CASE WHEN p_size % 4 > 0 THEN 'regex' ELSE 'ner' END AS layer FROM part WHERE p_size % 4 > 0 OR p_size % 5 > 0)
    SELECT layer, count(*) AS filled, CAST(0 AS BIGINT) AS outside FROM c GROUP BY 1""")
def layer_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = [part.selectExpr("p_partkey", "'rate' AS field", f"'{n}' AS layer", f"CAST(IF(p_size % {m} > 0, 1, NULL) AS DOUBLE) AS value", "0.9D AS confidence") for n, m in (("regex", 4), ("ner", 5))]
    return verification.layer_contribution(verification.reconcile(rows[0].unionByName(rows[1]), ["p_partkey"], ["regex", "ner"]), ["rate"])


@add("""
    SELECT a.p_partkey, coalesce(nullif(a.p_size % 7, 0), b.rate) AS rate, coalesce(nullif(a.p_size % 5, 0), b.term) AS term,
      (a.p_size % 7 = 0 AND b.rate IS NOT NULL)::INT + (a.p_size % 5 = 0 AND b.term IS NOT NULL)::INT AS filled
    FROM part a LEFT JOIN (SELECT p_partkey, p_size AS rate, nullif(p_size % 3, 0) AS term FROM part WHERE p_partkey % 2 = 0) b USING (p_partkey)""")
def filled_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    new = part.where("p_partkey % 2 = 0").selectExpr("p_partkey", "p_size AS rate", "nullif(p_size % 3, 0) AS term")
    return verification.fill_nulls(_part(spark, sf_dir).select("p_partkey", "rate", "term"), new, "p_partkey", ["rate", "term"])


# texts made from numbers, in words that both engines put together alike
_OFFER = """concat('Özel kampanya. ', CASE WHEN k % 5 = 0 THEN 'Kâr paysız fırsat' WHEN k % 5 = 1 THEN concat('Aylık kâr oranı %', 1 + k % 3, ',', 10 + k % 80)
    WHEN k % 5 = 2 THEN concat('%', 1 + k % 9, ' kâr payı') WHEN k % 5 = 3 THEN 'Tahsis ücreti %1' ELSE 'Vade farksız' END, '. ',
    CASE WHEN k % 3 = 0 THEN concat(10 + k % 90, '.000 TL - ', 200 + k % 700, '.000 TL arası finansman. ') WHEN k % 3 = 1 THEN concat(100 + k % 800, ' bin TL''ye kadar. ') ELSE '' END,
    CASE WHEN k % 4 = 0 THEN concat(12 + k % 100, ' aya varan vade. ') WHEN k % 4 = 1 THEN concat(1 + k % 9, ' yıl vade. ') WHEN k % 4 = 2 THEN concat(2 + k % 11, ' taksit. ') ELSE concat(1 + k % 6, ' ay ödemesiz dönem. ') END,
    CASE WHEN k % 7 = 0 THEN concat('En fazla ', 100 + k % 900, ' TL ödül. ') WHEN k % 7 = 1 THEN concat(100 + k % 900, ' ParafPara. ') WHEN k % 7 = 2 THEN concat(50 + k % 40, ' gram. ') ELSE '' END,
    CASE WHEN k % 2 = 0 THEN concat('01.0', 1 + k % 9, '.2026 - 28.0', 1 + k % 9, '.2026 arasında.') ELSE concat('Son gün ', 10 + k % 18, ' Mart 2026.') END)"""


@add(f"""
    WITH t AS (SELECT DISTINCT o_orderkey AS k, o_orderkey AS o FROM orders)
    SELECT k, CASE WHEN k % 5 IN (0, 4) THEN 0.0::DOUBLE WHEN k % 5 = 1 THEN 1 + k % 3 + (10 + k % 80) / 100.0::DOUBLE WHEN k % 5 = 2 THEN (1 + k % 9)::DOUBLE END AS rate,
      CASE WHEN k % 3 = 0 THEN (200 + k % 700) * 1000.0::DOUBLE WHEN k % 3 = 1 THEN (100 + k % 800) * 1000.0::DOUBLE END AS amount,
      CAST(CASE WHEN k % 4 = 0 THEN 12 + k % 100 WHEN k % 4 = 1 THEN 12 * (1 + k % 9) END AS INT) AS term, CAST(CASE WHEN k % 4 = 2 THEN 2 + k % 11 END AS INT) AS instalments,
      CAST(CASE WHEN k % 4 = 3 THEN 1 + k % 6 END AS INT) AS deferral, CASE WHEN k % 7 IN (0, 1) THEN (100 + k % 900)::DOUBLE WHEN k % 7 = 2 THEN (50 + k % 40)::DOUBLE END AS reward,
      CASE k % 7 WHEN 0 THEN 'TL' WHEN 1 THEN 'ParafPara' WHEN 2 THEN 'Gram' END AS unit,
      CASE WHEN k % 2 = 0 THEN concat('2026-0', 1 + k % 9, '-01') END AS starts, CASE WHEN k % 2 = 0 THEN concat('2026-0', 1 + k % 9, '-28') ELSE concat('2026-03-', 10 + k % 18) END AS ends,
      CASE k % 5 WHEN 0 THEN 'Kâr paysız' WHEN 1 THEN concat('%', 1 + k % 3, ',', 10 + k % 80) WHEN 2 THEN concat('%', 1 + k % 9) WHEN 4 THEN 'Vade farksız' END AS rate_span,
      CASE k % 5 WHEN 0 THEN 0.85 WHEN 4 THEN 0.8 WHEN 3 THEN NULL ELSE 0.9 END::DOUBLE AS rate_confidence FROM t""")
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _orders(spark, sf_dir).withColumn("text", F.expr(_OFFER))
    out = extraction.with_fields(texts, "text", "_")
    return out.select(
        "k", *[F.col(f"_{n}")["value"].alias(n) for n in ("rate", "amount", "term", "instalments", "deferral", "reward")], F.col("_reward")["unit"].alias("unit"),
        F.col("_start")["value"].alias("starts"), F.col("_end")["value"].alias("ends"), F.col("_rate")["span"].alias("rate_span"), F.col("_rate")["confidence"].alias("rate_confidence"),
    )


@add("""
    WITH t AS (SELECT DISTINCT o_orderkey AS k FROM orders)
    SELECT k, CASE WHEN k % 3 < 2 THEN k % 2 = 0 END AS rate_ok, CASE WHEN k % 4 > 0 THEN true END AS term_ok FROM t""")
def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('Kâr payı oranı %', 1 + k % 5, ',', 25 + k % 50, ' olarak uygulanır. Vade ', 12 + k % 48, ' aydır. Başka bir cümle 99,99 der.')"
    claims = _orders(spark, sf_dir).selectExpr(
        "k", f"{text} AS text", "IF(k % 3 < 2, IF(k % 2 = 0, 1 + k % 5 + (25 + k % 50) / 100.0D, 99.99D), NULL) AS rate", "IF(k % 4 > 0, CAST(12 + k % 48 AS DOUBLE), NULL) AS term"
    )
    return claims.select("k", verification.confirmed(F.col("text"), F.col("rate"), "rate").alias("rate_ok"), verification.confirmed(F.col("text"), F.col("term"), "term").alias("term_ok"))


@add("""
    WITH f AS (SELECT p_brand, 'a' AS field, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok FROM part UNION ALL SELECT p_brand, 'b', CASE WHEN p_size % 2 = 0 THEN true END FROM part),
    s AS (SELECT p_brand, field, count(*) FILTER (ok) AS confirmed, count(*) FILTER (NOT ok) AS refuted, count(*) FILTER (ok IS NULL) AS not_run FROM f GROUP BY 1, 2)
    SELECT *, CASE WHEN refuted > 0 THEN 'refuted' WHEN confirmed = 0 THEN 'not_run' WHEN not_run > 0 THEN 'partly' ELSE 'confirmed' END AS state FROM s""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "part").selectExpr("p_brand", "CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a", "CASE WHEN p_size % 2 = 0 THEN true END AS b")
    return verification.verification_summary(flags, ["p_brand"], {"a": "a", "b": "b"})


@add("""
    SELECT DISTINCT o_orderkey AS k, concat('yaz ', CASE o_orderkey % 5 WHEN 0 THEN '[EPOSTA]' WHEN 1 THEN '[IBAN]' WHEN 2 THEN '[KART]' WHEN 3 THEN '[TELEFON]' ELSE '[TCKN]' END, ' ya da 12345678901 bitti') AS text,
      CAST((o_orderkey % 5 = 0) AS INT) AS n_email, CAST((o_orderkey % 5 = 4) AS INT) AS n_identity FROM orders""")
def masked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = "lpad(CAST(k % 10000 AS STRING), 4, '0')"
    kinds = f"""CASE k % 5 WHEN 0 THEN concat('ayşe.öz', k, '@çığ-banka.com.tr') WHEN 1 THEN concat('TR12 0001 0002 0003 0004 {'0'}', right({digits}, 1), '45 67') WHEN 2 THEN concat('4111-1111 1111-', {digits})
      WHEN 3 THEN concat('+90 532 123 ', right({digits}, 2), ' 45') ELSE '10000000146' END"""
    rows = _orders(spark, sf_dir).selectExpr("k", f"concat('yaz ', {kinds}, ' ya da 12345678901 bitti') AS text")
    return rows.select("k", T.masked(F.col("text")).alias("m")).select("k", "m.text", "m.n_email", "m.n_identity")


@add("""
    WITH t AS (SELECT DISTINCT o_orderkey AS k FROM orders)
    SELECT k, (1 + k % 9 + 0.5::DOUBLE) / 100 AS percent, (1 + k % 900) * 1000.0::DOUBLE AS amount, concat('2026-0', 1 + k % 9, '-1', k % 10) AS day, CAST(12 * (1 + k % 9) AS INT) AS months,
      CASE WHEN k % 2 = 0 THEN k::DOUBLE + 0.5 END AS strict, CASE WHEN k % 3 = 0 THEN DATE '2026-02-28' END AS strict_day, CAST(greatest(0, 10 - k % 20) AS INT) AS gap,
      concat(1 + k % 9, '.500', CASE WHEN k % 2 = 0 THEN ',5' ELSE '' END) AS written FROM t""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    e = F.expr
    return rows.select(
        "k", numbers.percent(e("concat('%', 1 + k % 9, ',5')")).alias("percent"), numbers.amount(e("concat(1 + k % 900, ' bin TL')")).alias("amount"),
        numbers.iso_date(e("concat('1', k % 10, '.0', 1 + k % 9, '.2026')")).alias("day"), numbers.months(e("concat(1 + k % 9, ' yıl')")).alias("months"),
        numbers.strict_number(e("concat(k, '.5', IF(k % 2 = 0, '', ' TL'))")).alias("strict"),
        numbers.strict_date(e("CASE k % 3 WHEN 0 THEN '2026-02-28 10:00' WHEN 1 THEN '2026-02-31' ELSE '28.02.2026' END")).alias("strict_day"),
        numbers.day_gap(e("date_add(DATE '2026-01-01', CAST(k % 20 AS INT))"), F.lit("2026-01-11").cast("date")).alias("gap"),
        numbers.written_short(e("(1 + k % 9) * 1000 + 500 + IF(k % 2 = 0, 0.5D, 0.0D)")).alias("written"),
    )


@add("""
    SELECT DISTINCT o_orderkey AS k, (1 + o_orderkey % 900) * 1000.0::DOUBLE AS principal, CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_orderkey % 4 + 0.25::DOUBLE END AS rate_percent, CAST(6 + o_orderkey % 50 AS INT) AS months FROM orders""")
def question_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    asked = numbers.question_parameters(F.expr("concat(1 + k % 900, '.000 TL için ', IF(k % 2 = 0, concat('%', 1 + k % 4, ',25 oranla '), ''), 6 + k % 50, ' ay taksit ne olur?')"))
    return rows.select("k", *[c.alias(n) for n, c in asked.items()])


_THEMES = {"reward": ["odul yatmadi", "puan gecmedi"], "fee": ["ucret kesildi", "komisyon kesildi"], "date": ["bitis tarihi"]}


@add("""
    SELECT DISTINCT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'reward' WHEN 1 THEN 'fee' WHEN 2 THEN 'date' END AS name, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN 0.85 WHEN o_orderkey % 4 < 3 THEN 0.6 END::DOUBLE AS confidence FROM orders""")
def complaint_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE k % 4 WHEN 0 THEN concat('Ödül yatmadı', IF(k % 8 = 0, ' ve puan geçmedi', '')) WHEN 1 THEN 'ÜCRET KESİLDİ' WHEN 2 THEN 'Bitiş tarihi yanlış' ELSE 'teşekkürler' END"
    rows = _orders(spark, sf_dir)
    return rows.select("k", complaints.theme(F.expr(text), _THEMES).alias("t")).select("k", "t.name", "t.confidence")


@add("""
    SELECT s_suppkey AS complaint_id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey::BIGINT END AS campaign_id,
      CASE WHEN s_suppkey % 3 = 0 THEN 0.8 WHEN s_suppkey % 3 = 1 THEN 0.35 ELSE 0.0 END::DOUBLE AS score, CASE s_suppkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'low_score' ELSE 'no_candidate' END AS why FROM supplier""")
def complaint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    campaigns = table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS campaign_id", "concat('Banka', n_nationkey, 'x') AS bank", "concat('Özel bahar', n_nationkey, 'x kampanyası') AS name",
        "CAST(NULL AS STRING) AS unit", "DATE '2026-01-01' AS start", "DATE '2026-03-01' AS end",
    )
    said = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS complaint_id", "CASE s_suppkey % 3 WHEN 0 THEN concat('BANKA', s_nationkey, 'x ve bahar', s_nationkey, 'x yok') WHEN 1 THEN concat('yalnız bahar', s_nationkey, 'x') ELSE concat('banka', s_nationkey, 'x çok geç') END AS text",
        "IF(s_suppkey % 3 = 2, DATE '2026-09-01', IF(s_suppkey % 2 = 0, DATE '2026-04-20', NULL)) AS day",
    )
    return complaints.match_campaigns(said, campaigns)


_UNIT_VECTORS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


@add(f"""
    WITH {_UNIT_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 50 = 0)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS position FROM s QUALIFY position <= 5""")
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_search(asked, vectors, "query_id", "vec_id", 5).withColumn("score", F.round("score", 6))


@add(f"""
    WITH {_UNIT_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
    a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS a FROM s QUALIFY a <= 20),
    b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(query_id - vec_id), vec_id) AS b FROM s QUALIFY b <= 20),
    f AS (SELECT query_id, vec_id, round(coalesce(1 / (60 + a)::DOUBLE, 0) + coalesce(1 / (60 + b)::DOUBLE, 0), 8) AS score FROM a FULL JOIN b USING (query_id, vec_id))
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS position FROM f QUALIFY position <= 5""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    dense = retrieval.dense_search(asked, vectors, "query_id", "vec_id", 20)
    near = asked.select("query_id").withColumn("vec_id", F.explode(F.sequence(F.col("query_id") - 40, F.col("query_id") + 40))).join(vectors.select("vec_id"), "vec_id")
    other = retrieval.top(near.withColumn("score", -F.abs(F.col("query_id") - F.col("vec_id"))), "query_id", "vec_id", 20)
    return retrieval.fuse(dense, other, "query_id", "vec_id", 5)


@add(f"""
    WITH {_UNIT_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
    f AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS position FROM s QUALIFY position <= 5),
    x AS (SELECT DISTINCT q.vec_id AS query_id, q.vec_id % 3 AS category, e.vec_id FROM e q JOIN e ON e.vec_id % 7 = q.vec_id % 7 AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    h AS (SELECT query_id, min(position) AS best FROM f JOIN x USING (query_id, vec_id) GROUP BY 1),
    r AS (SELECT query_id, category, best FROM (SELECT DISTINCT query_id, category FROM x) LEFT JOIN h USING (query_id))
    SELECT category, count(*) AS n, round(avg(coalesce(best <= 1, false)::INT), 6) AS recall_1, round(avg(coalesce(best <= 5, false)::INT), 6) AS recall_5 FROM r GROUP BY ROLLUP (category)""")
def recall_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = retrieval.top(retrieval.dense_search(asked, vectors, "query_id", "vec_id", 6).where("query_id <> vec_id"), "query_id", "vec_id", 5)
    ids = vectors.select("vec_id", (F.col("vec_id") % 7).alias("m"))
    expected = asked.select("query_id", (F.col("query_id") % 3).alias("category"), (F.col("query_id") % 7).alias("m")).join(ids, "m").where("query_id <> vec_id").drop("m")
    return retrieval.recall_at(found, expected, "query_id", "vec_id", "category", (1, 5))


@add("""
    SELECT DISTINCT o_orderkey AS k, round(CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2 / 3.0::DOUBLE WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE, 6) AS share, o_orderkey % 4 < 3 AS enough FROM orders""")
def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).selectExpr(
        "k", "CASE k % 4 WHEN 0 THEN 'konut finansmanı vade' WHEN 1 THEN 'konut finansmanları bahçe' WHEN 2 THEN 'konut için ve bahçe' ELSE 'uzay mekiği nedir' END AS asked",
        "'Konut finansmanı 120 ay vade ile sunulur' AS said",
    )
    return rows.select("k", F.round(retrieval.overlap(F.col("asked"), F.col("said")), 6).alias("share"), retrieval.sufficient(F.col("asked"), F.col("said")).alias("enough"))


@add("""SELECT o_orderkey % 2 AS category, round(avg((o_orderkey % 4 = 3)::INT), 6) AS abstained, count(*) AS n FROM orders GROUP BY 1""")
def abstention_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 2 AS category", "IF(o_orderkey % 4 = 3, 'uzay mekiği nedir', 'konut vade') AS asked", "'Konut finansmanı 120 ay vade ile sunulur' AS said")
    enough = retrieval.sufficient(F.col("asked"), F.col("said"))
    return rows.groupBy("category").agg(F.round(F.avg((~enough).cast("int")), 6).alias("abstained"), F.count(F.lit(1)).alias("n"))


@add("""
    WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
    p AS (SELECT page_id, string_split(host, '.') AS s FROM h)
    SELECT page_id, array_to_string(s[-2:], '.') AS domain, len(s) > 2 AS below FROM p""")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.registrable(host).alias("domain"), (F.size(F.split(host, "[.]")) > 2).alias("below"))


@add("""
    SELECT DISTINCT o_orderkey AS k, concat('kampanya-', o_orderkey % 50, '-ozel-firsat') AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'Konut Finansmani Kampanyasi' WHEN o_orderkey % 3 = 1 THEN 'Kart Kampanyasi' END AS kind,
      CASE WHEN o_orderkey % 2 = 0 THEN concat('deger ', o_orderkey % 9) END AS json_value, concat('x', o_orderkey % 9) AS from_lines, '98/2' = '98/2' AND o_orderkey % 5 = 0 AS fraction,
      concat('Metin ', o_orderkey % 9, '.', chr(10), chr(10), 'son') AS tidy FROM orders""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    e = F.expr
    return rows.select(
        "k", T.slug(e("concat('Kampanya ', k % 50, ': Özel Fırsat!')")).alias("slug"),
        T.offer_kind(e("CASE k % 3 WHEN 0 THEN 'KONUT FİNANSMANI ve kredi kartı' WHEN 1 THEN 'kredi kartı avantajı' ELSE 'bilgi' END")).alias("kind"),
        T.json_body(e("concat('cevap: ', IF(k % 2 = 0, concat('{\"v\": \"deger ', k % 9, '\"}'), '{bozuk'), ' bitti')"), "v string")["v"].alias("json_value"),
        T.key_values(e("concat('a: 1\\nad : x', k % 9, '\\nbozuk satır')"))["ad"].alias("from_lines"),
        T.is_fraction(e("IF(k % 5 = 0, '98/2', '98.2')")).alias("fraction"),
        T.tidy(e("concat('Metin \t ', k % 9, '.\\n\\n\\n\\nson ')")).alias("tidy"),
    )


@add("""
    SELECT DISTINCT o_orderkey AS k, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS INT) AS n FROM orders""")
def terminology_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE k % 4 WHEN 0 THEN 'Kredi başvurusu, açık kredi' WHEN 1 THEN 'kredi kartı ve kredisiz' WHEN 2 THEN 'finansman' ELSE 'Krediyle krediler' END"
    rows = _orders(spark, sf_dir)
    return rows.select("k", verification.leaks(F.expr(text), "kredi", ("siz",), ("kart", "limit"), ("acik", "veresiye")).alias("n"))


@add("""
    SELECT DISTINCT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Cümle iki vade içerir!' ELSE '' END AS evidence, CASE WHEN o_orderkey % 2 = 0 THEN 'Uzun Bir Kampanya Adi Burada' ELSE 'Yeterince uzun bir ilk satır' END AS title FROM orders""")
def evidence_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    text = F.expr("IF(k % 3 = 0, 'Cümle bir. Cümle iki vade içerir! Son?', 'Hiçbiri yok. Son.')")
    title = T.title(F.expr("IF(k % 2 = 0, 'https://b.com/uzun-bir-kampanya-adi-burada', 'https://b.com/kisa')"), F.lit("ana sayfa\nab\nYeterince uzun bir ilk satır\ndevam"))
    return rows.select("k", F.concat_ws("|", T.evidence(text, "vade")).alias("evidence"), title.alias("title"))


@add("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'refreshed' WHEN p_partkey % 3 = 1 THEN 'kept' ELSE 'added' END AS status, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END AS seen,
      CASE WHEN p_partkey % 3 < 2 THEN p_size END AS p_size FROM part""")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stored = part.where("p_partkey % 3 < 2").selectExpr("p_partkey", "1 AS seen", "p_size")
    new = part.where("p_partkey % 3 <> 1").selectExpr("p_partkey", "2 AS seen")
    return sinks.insert_missing(stored, new.unionByName(new), "p_partkey", "seen", ["p_size"])


@add("""
    SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0 OR s_nationkey % 3 = 1 AND s_nationkey % 2 = 0""")
def permitted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    permits = table(spark, sf_dir, "nation").selectExpr(
        "IF(n_nationkey % 3 = 2, NULL, concat('Kaynak', n_nationkey)) AS source", "DATE '2026-01-01' AS approved", "IF(n_nationkey % 3 = 1, IF(n_nationkey % 2 = 0, DATE '2026-12-31', DATE '2026-02-01'), NULL) AS expires"
    )
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('KAYNAK', s_nationkey) AS source")
    return complaints.permitted(rows, permits, "source", F.lit("2026-06-01").cast("date")).select("s_suppkey")


@add("""
    SELECT DISTINCT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 1 END::INT AS n_rate, '12 ay|%' || (o_orderkey % 5) AS first_row, 2 AS n_tables FROM orders""")
def html_rate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = """concat('<p>x</p><table><tr><th>', IF(k % 2 = 0, 'Vade', 'Tutar'), '</th><th>Kâr <b>Oranı</b></th></tr><tr><td> </td><td></td></tr><tr><td>12 ay</td><td>%', k % 5, '</td></tr></table>',
      '<TABLE border=1><tr><td>a</td></tr></TABLE>')"""
    rows = _orders(spark, sf_dir).select("k", tables.html_tables(F.expr(html)).alias("t"))
    found = tables.rate_tables(F.col("t"))
    return rows.select("k", F.size(found).alias("n_rate"), F.array_join(F.col("t")[0]["rows"][0], "|").alias("first_row"), F.size("t").alias("n_tables")).withColumn(
        "n_rate", F.when(F.col("k") % 2 == 0, F.col("n_rate"))
    )


@add("""
    SELECT DISTINCT o_orderkey AS k, concat('http://b.com/l#baslik-', o_orderkey % 7) AS section_url, concat('Başlık ', o_orderkey % 7) AS title, 'metin' AS body FROM orders
    UNION ALL SELECT DISTINCT o_orderkey, 'http://b.com/l#son', 'Son', 'bitti' FROM orders""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).selectExpr("k", "'http://b.com/l' AS url", "concat('<div>önce</div><h2 class=x>Başlık ', k % 7, '</h2><p>metin</p><H3>Son</H3>bitti') AS html")
    return tables.sections(rows, "k", "url", "html")


@add("""
    SELECT DISTINCT o_orderkey AS k, concat('http://b.com/kampanya/', o_orderkey % 7) AS link FROM orders UNION ALL SELECT DISTINCT o_orderkey, 'http://b.com/kampanya/x' FROM orders""")
def own_host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = "concat('<a href=\"/kampanya/', k % 7, '?q=1\">a</a><a class=y href=\"//b.com/kampanya/x#z\">b</a><a href=\"http://other.com/kampanya/1\">c</a><a href=\"/Kampanya/arsiv/2\">d</a><a href=\"/hakkimizda\">e</a><a href=\"/kampanya/{id}\">f</a>')"
    rows = _orders(spark, sf_dir).selectExpr("k", "'http://b.com/liste?x' AS url", f"{html} AS html")
    return tables.links(rows, "k", "url", "html", "/kampanya/", "arsiv")


@add("""SELECT DISTINCT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'Metin' ELSE 'Metin yok' END AS text, o_orderkey % 2 = 0 AS changed FROM orders""")
def scope_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).selectExpr("k", "IF(k % 2 = 0, 'Metin\\nDetaylı bilgi almak için: başka', 'Metin yok') AS text")
    return sinks.migrated(rows, "text", "\nDetaylı bilgi almak için:")


@add("""
    SELECT o_orderkey, [NULL, 'hesaplama', 'karsilastirma', 'sozluk', 'toplam_maliyet'][CAST(o_orderkey % 5 AS INT) + 1] AS kind,
      CASE o_orderkey % 5 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS confidence,
      CASE WHEN o_orderkey % 5 = 2 THEN 'en_uzun_vade' ELSE 'en_dusuk_kar_payi' END AS criterion, CASE WHEN o_orderkey % 5 = 3 THEN 'vade ' || o_orderkey END AS term FROM orders""")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "element_at(array('Merhaba', 'AYLIK ÖDEME ve taksit', 'Hangisi daha iyi, en uzun vade', concat('Vade ', o_orderkey, ' ne demek?'), 'Toplam maliyet'), CAST(o_orderkey % 5 AS INT) + 1)"
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{asked} AS q").select("o_orderkey", "q", questions.intent(F.col("q")).alias("i"))
    term = F.when(F.col("i.name") == "sozluk", questions.term_asked(F.col("q")))
    kind = F.nullif(F.col("i.name"), F.lit("bilinmiyor"))
    return orders.select("o_orderkey", kind.alias("kind"), "i.confidence", questions.criterion(F.col("q")).alias("criterion"), term.alias("term"))


@add("""
    WITH o AS (SELECT o_orderkey, 1000 * o_custkey + 500 AS p, o_orderkey % 9 + 0.5::DOUBLE AS r, CAST(6 + o_orderkey % 31 AS INT) AS n, o_orderkey % 7 = 0 AS short FROM orders)
    SELECT o_orderkey, p::DOUBLE AS principal, CASE WHEN NOT short THEN r END AS rate_percent, n AS months,
      CASE WHEN NOT short AND p <= 1e8 THEN round(p * (r / 100) * pow(1 + r / 100, n) / (pow(1 + r / 100, n) - 1), 2) END AS instalment FROM o""")
def question_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = "replace(format_number(1000 * o_custkey + 500, 0), ',', '.')"
    rate = "IF(o_orderkey % 7 = 0, '', concat(', yüzde ', o_orderkey % 9, ',5 oranla'))"
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat({amount}, ' TL', {rate}, ' ', 6 + o_orderkey % 31, ' ay vadeyle ne kadar öderim?') AS q")
    return questions.with_calculation(asked, "q").select("o_orderkey", "principal", "rate_percent", "months", "instalment")


@add(f"""
    WITH b AS (SELECT p_brand AS bank, p_partkey AS offer, 1 + p_size % 7 AS rate, nullif(p_size % 5, 0) * 12 AS term FROM part),
    f AS (SELECT bank, arg_min(rate, offer) AS rate, arg_min(term, offer) AS term FROM b WHERE term IS NOT NULL GROUP BY 1),
    c AS (SELECT *, round(300000 * (rate / 100.0::DOUBLE) * pow(1 + rate / 100.0::DOUBLE, term) / (pow(1 + rate / 100.0::DOUBLE, term) - 1) * term, 2) AS total FROM f),
    q AS (SELECT o_orderkey AS k, o_orderkey % 5 AS kind, o_custkey * 1000 + 500 AS p, concat('Brand#', 2 + o_orderkey % 2) AS b1, concat('Brand#', 4 + o_orderkey % 2) AS b2 FROM orders),
    least AS (SELECT k, min(rate) AS v FROM q JOIN b ON bank IN (b1, b2) WHERE kind = 1 GROUP BY k),
    cost AS (SELECT k, count(*) AS n, arg_min(bank, (total, bank)) AS pick, min(total) AS v FROM q JOIN c ON bank IN (b1, b2) WHERE kind = 2 GROUP BY k),
    pick AS (SELECT k, arg_min(bank, offer) AS pick FROM least JOIN q USING (k) JOIN b ON bank IN (b1, b2) AND rate = v GROUP BY k)
    SELECT k, CASE kind WHEN 0 THEN 'hesaplama' WHEN 1 THEN 'karsilastirma' WHEN 2 THEN 'toplam_maliyet' ELSE 'bilgi' END AS intent,
      CASE kind WHEN 0 THEN 'calculator' WHEN 1 THEN 'sql' WHEN 2 THEN 'calculator' WHEN 3 THEN 'rag' ELSE 'fallback' END AS tool, kind < 4 AND coalesce(cost.n, 2) = 2 AS ok,
      CASE kind WHEN 0 THEN '12' WHEN 1 THEN pick.pick WHEN 2 THEN cost.pick WHEN 3 THEN cast(k % 5 AS VARCHAR) END AS pick,
      CASE kind WHEN 0 THEN round(p * 0.02::DOUBLE * pow(1.02::DOUBLE, 12) / (pow(1.02::DOUBLE, 12) - 1), 2) WHEN 1 THEN least.v WHEN 2 THEN cost.v END::DOUBLE AS value,
      CASE kind WHEN 3 THEN 'calculator failed (missing: principal, rate_percent, months), answered from texts' WHEN 4 THEN 'no sufficient source' END AS reason
    FROM q LEFT JOIN least USING (k) LEFT JOIN pick USING (k) LEFT JOIN cost USING (k)""")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions put together from orders, one kind in five for each way an answer takes; banks are the brands, texts the regions."""
    bank = "'Brand#', {} + o_orderkey % 2"
    kinds = [
        "concat(replace(format_number(o_custkey * 1000 + 500, 0), ',', '.'), ' TL %2 12 ay taksit')", f"concat('en düşük oran, karşılaştır: ', {bank.format(2)}, ' ile ', {bank.format(4)}, '?')",
        f"concat('Toplam maliyet 300.000 TL: ', {bank.format(2)}, ' ', {bank.format(4)})", "concat('taksit bolge', o_orderkey % 5)", "'penguenler uzayda'",
    ]
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"element_at(array({', '.join(kinds)}), CAST(o_orderkey % 5 AS INT) + 1) AS text")
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS bank", "p_partkey AS offer", "CAST(1 + p_size % 7 AS DOUBLE) AS rate", "nullif(p_size % 5, 0) * 12 AS term", "CAST(NULL AS DOUBLE) AS fee", "CAST(NULL AS DOUBLE) AS reward", "'TL' AS unit"
    )
    banks = rows.select("bank").distinct().where("bank IN ('Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')")
    chunks = table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS STRING) AS doc", "concat('bolge', r_regionkey) AS body")
    of = {"key": "k", "text": "text"}
    tools = {
        "hesaplama": partial(answers.calculated, **of), "karsilastirma": partial(answers.compared, **of, banks=banks, name="bank", offers=rows),
        "toplam_maliyet": partial(answers.costed, **of, banks=banks, name="bank", offers=rows),
    }
    found = answers.answered(asked, "k", "text", tools, partial(answers.from_texts, **of, chunks=chunks, doc="doc", body="body"))
    return found.select("k", "intent", "tool", "ok", "pick", F.when(F.col("tool") != "rag", F.col("value")).alias("value"), "reason")


@add("""
    WITH r AS (SELECT c_nationkey AS bank, 'http://b' || c_nationkey || '.com/tr/kampanya-' || (c_custkey % 3) || '/' || c_custkey || '-firsati/detay' AS url FROM customer WHERE c_custkey % 3 > 0)
    SELECT c_custkey AS gold, min(r.url) AS url, count(r.url) AS n_candidates FROM customer LEFT JOIN r ON r.bank = c_nationkey AND contains(r.url, c_custkey || '-firsati') GROUP BY 1""")
def slug_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows and snapshots put together from customers: a third of the pages are gone."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS gold", "CAST(c_nationkey AS STRING) AS bank", "concat('https://www.b.com/', c_custkey, '-firsati/') AS url", "'Ad' AS name")
    raw = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").selectExpr(
        "CAST(c_nationkey AS STRING) AS bank", "concat('http://b', c_nationkey, '.com/tr/kampanya-', c_custkey % 3, '/', c_custkey, '-firsati/detay') AS url", "'Metin' AS text"
    )
    return matching.by_slug(rows, raw, "gold")
