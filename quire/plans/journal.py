"""Journal and evaluation queries, and a few over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import evaluation as E
from quire.operators import journal as J
from quire.runtime import ranged_neighbours, table

NOW = "TIMESTAMP_NTZ '2025-06-01 00:00:00'"


def _searches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_log").distinct().withColumnRenamed("log_id", "search_id")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads: of every third search the first hit, some minutes after."""
    s = _searches(spark, d).where("search_id % 3 = 0 AND size(hits) > 0")
    return s.select((F.col("at") + F.expr("make_dt_interval(0, 0, search_id % 60)")).alias("at"), "origin", F.get("hits", F.lit(0)).alias("chunk_id"))


def journal_usage(spark: SparkSession, d: str) -> DataFrame:
    return J.usage(_searches(spark, d), _reads(spark, d))


def journal_retained(spark: SparkSession, d: str) -> DataFrame:
    return J.retained(_searches(spark, d), F.expr(NOW)).select("search_id")


def journal_listing(spark: SparkSession, d: str) -> DataFrame:
    return J.listed(_searches(spark, d), 30, empty_only=True).select("search_id", "at", "origin", "query")


def journal_daily(spark: SparkSession, d: str) -> DataFrame:
    return J.daily(_searches(spark, d))


def events_usage(spark: SparkSession, d: str) -> DataFrame:
    """Views as searches and clicks as reads of the events table: users by whether a view was followed by a click within half an hour."""
    e = table(spark, d, "events")
    s = e.where("event_type = 'view'").select(F.col("event_id").alias("search_id"), F.col("user_id").cast("string").alias("origin"), F.col("ts").alias("at"), F.array(F.col("user_id")).alias("hits"), F.lit("").alias("err"))
    r = e.where("event_type = 'click'").select(F.col("ts").alias("at"), F.col("user_id").cast("string").alias("origin"), F.col("user_id").alias("chunk_id"))
    return J.usage(s, r)


def heartbeat(spark: SparkSession, d: str) -> DataFrame:
    beats = table(spark, d, "search_log").select(F.col("logged_at").alias("at"), F.lit("indexing").alias("phase"))
    return J.pulse(beats, F.expr(NOW)).select("at", "phase", F.round("silence", 3).alias("silence"), "alive")


def _run(spark: SparkSession, d: str, how: str) -> DataFrame:
    """A run of judged queries: searches ask for their first hit's source."""
    hits = _searches(spark, d).where("size(hits) > 1").select("search_id", "mode", F.col("hits")[0].alias("want"), F.posexplode("hits" if how == "a" else F.reverse("hits")).alias("p", "chunk_id"))
    return hits.select(F.col("search_id").alias("query_id"), "mode", (F.col("p") + 1).alias("pos"), (F.col("chunk_id") % 97 == F.col("want") % 97).alias("rel"))


def run_measures(spark: SparkSession, d: str) -> DataFrame:
    return E.measures(_run(spark, d, "b")).withColumn("rr", F.round("rr", 9))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    run = _run(spark, d, "b")
    m = E.measures(run).join(run.select("query_id", "mode").distinct(), "query_id").withColumn("style", F.when(F.col("query_id") % 2 == 0, "exact").otherwise("paraphrase"))
    out = E.report(m, ["mode", "style"])
    return out.select("mode", "style", "queries", *(F.round(c, 9).alias(c) for c in ("mrr", "p5", "found")))


def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return E.outcomes(E.measures(_run(spark, d, "a")), E.measures(_run(spark, d, "b"))).withColumn("delta", F.round("delta", 9))


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    c = E.compare(E.measures(_run(spark, d, "a")), E.measures(_run(spark, d, "b")))
    return spark.createDataFrame([(c["wins"], c["losses"], c["ties"], c["delta"], c["p_sign"], c["p_random"])], "wins int, losses int, ties int, delta double, p_sign double, p_random double")


def list_recall(spark: SparkSession, d: str) -> DataFrame:
    s = _searches(spark, d).where("hits IS NOT NULL")
    exact = s.select(F.col("search_id").alias("query_id"), F.array_distinct("hits").alias("ids"))
    near = s.select(F.col("search_id").alias("query_id"), F.array_distinct(F.filter("hits", lambda x: x % 3 != 0)).alias("ids"))
    return E.recall(exact, near).withColumn("recall", F.round("recall", 9))


def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.sample(table(spark, d, "documents").select(F.col("doc_id").alias("query"), "source"), 4)


def note_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("kind = 'vault'")
    s = ranged_neighbours(s.select("path", "title", "aliases", "source_id", F.lit("vault").alias("k")), "k", "source_id", F.lit(None).cast("string"), F.col("title"))
    body = F.concat(F.lit("see [["), "_after", F.lit("#Intro|about "), "_after", F.lit("]]"))
    return E.mine_pairs(s.select("path", F.col("title").alias("name"), "aliases", body.alias("body")))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums by flag and status, with totals."""
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    out = li.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
    return out


def segment_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by market segment and nation: the large tables are joined once, the small ones broadcast by their size."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    j = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("orders"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """A value out of a JSON column, by type of event."""
    v = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("k"))


QUERIES = {f.__name__: f for f in (journal_usage, journal_retained, journal_listing, journal_daily, events_usage, heartbeat, run_measures, run_report, run_outcomes, run_comparison, list_recall, stable_sample, note_pairs, pricing_summary, segment_revenue, customers_without_orders, top_orders, event_props)}

_S = "s AS (SELECT DISTINCT log_id AS search_id, \"at\", logged_at, origin, query, mode, kind, hits, err FROM search_log)"
_USAGE = """SELECT origin, count(*) AS searches, count(*) FILTER (len(coalesce(hits, [])) = 0 AND coalesce(err, '') = '') AS empty, count(*) FILTER (coalesce(err, '') <> '') AS failed,
 count(*) FILTER (EXISTS (FROM r WHERE r.origin = s.origin AND list_contains(s.hits, r.chunk_id) AND r."at" >= s."at" AND r."at" < s."at" + INTERVAL 30 MINUTE)) AS read FROM s GROUP BY origin"""


def _m(hits: str) -> str:
    return f"""(SELECT query_id, any_value(mode) AS mode, coalesce(1.0 / min(pos) FILTER (rel), 0)::DOUBLE AS rr, count(*) FILTER (rel AND pos <= 5) / 5 AS p5, coalesce(min(pos) FILTER (rel) <= 10, false) AS found
 FROM (SELECT search_id AS query_id, mode, generate_subscripts(hits, 1) AS pos, unnest({hits}) % 97 = hits[1] % 97 AS rel FROM s WHERE len(hits) > 1) GROUP BY query_id)"""


ORACLE = {
    "journal_usage": f"WITH {_S}, r AS (SELECT \"at\" + to_minutes(search_id % 60) AS \"at\", origin, hits[1] AS chunk_id FROM s WHERE search_id % 3 = 0 AND len(hits) > 0) {_USAGE}",
    "journal_retained": f"WITH {_S} SELECT search_id FROM s WHERE \"at\" >= TIMESTAMP '2025-06-01' - INTERVAL 180 DAY",
    "journal_listing": f"WITH {_S} SELECT search_id, \"at\", origin, query FROM s WHERE len(coalesce(hits, [])) = 0 AND coalesce(err, '') = '' ORDER BY \"at\" DESC, search_id DESC LIMIT 30",
    "journal_daily": rf"""WITH {_S} SELECT CAST("at" AS DATE) AS day, origin, count(*) AS searches, sum(len(string_split_regex(trim(coalesce(query, '')), '\s+'))) AS words, sum(len(coalesce(hits, []))) AS hits FROM s GROUP BY 1, 2""",
    "events_usage": """WITH s AS (SELECT event_id, CAST(user_id AS VARCHAR) AS origin, ts AS "at", [user_id] AS hits, '' AS err FROM events WHERE event_type = 'view'), r AS (SELECT ts AS "at", CAST(user_id AS VARCHAR) AS origin, user_id AS chunk_id FROM events WHERE event_type = 'click')
SELECT origin, count(*) AS searches, 0 AS empty, 0 AS failed, count(*) FILTER (EXISTS (FROM r WHERE r.origin = s.origin AND r."at" >= s."at" AND r."at" < s."at" + INTERVAL 30 MINUTE)) AS read FROM s GROUP BY origin""",
    "heartbeat": "SELECT \"at\", 'indexing' AS phase, round(epoch_us(TIMESTAMP '2025-06-01') / 1e6 - epoch_us(\"at\") / 1e6, 3) AS silence, epoch_us(TIMESTAMP '2025-06-01') / 1e6 - epoch_us(\"at\") / 1e6 < 90 AS alive FROM (SELECT max(logged_at) AS \"at\" FROM search_log)",
    "run_measures": f"WITH {_S} SELECT query_id, round(rr, 9) AS rr, p5, found FROM {_m('list_reverse(hits)')}",
    "run_report": f"""WITH {_S}, m AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'exact' ELSE 'paraphrase' END AS style FROM {_m('list_reverse(hits)')})
SELECT mode, style, count(*) AS queries, round(avg(rr), 9) AS mrr, round(avg(p5), 9) AS p5, round(avg(found::INT), 9) AS found FROM m GROUP BY ROLLUP (mode, style)""",
    "run_outcomes": f"""WITH {_S} SELECT count(*) FILTER (b.rr > a.rr) AS wins, count(*) FILTER (b.rr < a.rr) AS losses, count(*) FILTER (b.rr = a.rr) AS ties, round(avg(b.rr - a.rr), 9) AS delta FROM {_m('hits')} a JOIN {_m('list_reverse(hits)')} b USING (query_id)""",
    "list_recall": f"""WITH {_S} SELECT search_id AS query_id, round(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_filter(e, lambda x: x % 3 <> 0)) / len(e) END, 9) AS recall FROM (SELECT search_id, list_distinct(hits) AS e FROM s WHERE hits IS NOT NULL)""",
    "stable_sample": "SELECT doc_id AS query, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR) || chr(0) || source)) <= 4",
    "note_pairs": """WITH v AS (SELECT path, title AS name, aliases, lead(title) OVER (ORDER BY source_id) AS t FROM sources WHERE kind = 'vault'),
n AS (SELECT lower(name) AS k, any_value(path) AS note, any_value(name) AS name FROM v GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT unnest(aliases) AS query, path AS note, name, '' AS section, 'alias' AS source FROM v
 UNION SELECT 'about ' || t, n.note, n.name, 'Intro', 'section' FROM v JOIN n ON n.k = lower(trim(regexp_replace(t, '^.*/', ''))) WHERE t IS NOT NULL),
f AS (SELECT DISTINCT * FROM e WHERE trim(query) <> '' AND lower(query) <> lower(name))
SELECT query, note, section, source FROM f WHERE lower(query) IN (SELECT lower(query) FROM f GROUP BY 1 HAVING count(DISTINCT note) = 1)""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "segment_revenue": "SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER w AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3",
    "event_props": "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type",
}
