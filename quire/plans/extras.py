"""Queries on records, queues and labels that the other modules leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evaluation as E
from quire.operators import pages as P
from quire.operators import search as S
from quire.operators import snapshots as N
from quire.runtime import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def reference_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", T.reference_key(F.col("kind"), F.col("path"), F.col("hash")).alias("key"))


def thin_files(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "sources").select("source_id", (F.col("source_id") % 30 + 1).alias("pages"))
    return P.thin(_chunks(spark, d).select("source_id", "page"), pages)


def scan_queue(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "sources").where("recognised").select("hash", "path", "kind", (F.col("source_id") % 40).alias("pages"), (F.col("source_id") % 17).alias("recognised"), (F.col("source_id") % 5).cast("int").alias("attempts"))
    return N.next_scans(files, 20).select("hash", "path")


def absent_drafts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("kind IN ('book', 'paper')").select(F.col("hash").alias("key"), "title")
    old = s.join(table(spark, d, "source_meta").join(table(spark, d, "sources"), "source_id").select(F.col("hash").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    return N.insert_absent(old, s.groupBy("key").agg(F.max("title").alias("title")), "key").select("key")


def alias_text(spark: SparkSession, d: str) -> DataFrame:
    """What is indexed of each chunk: a source's aliases go with its first chunk."""
    return S.indexed_text(_chunks(spark, d), table(spark, d, "sources")).select("chunk_id", F.length("body").alias("n_chars"))


def query_labels(spark: SparkSession, d: str) -> DataFrame:
    """How much of each logged query's words its first hit holds."""
    log = table(spark, d, "search_log").distinct().where("size(hits) > 0 AND trim(coalesce(query, '')) <> ''").select("log_id", "query", F.col("hits")[0].alias("chunk_id"))
    return E.word_share(log.join(_chunks(spark, d).select("chunk_id", "body"), "chunk_id"), "log_id").select("log_id", F.round("share", 9).alias("share"), "style")


QUERIES = {f.__name__: f for f in (reference_keys, thin_files, scan_queue, absent_drafts, alias_text, query_labels)}

ORACLE = {
    "reference_keys": "SELECT source_id, CASE WHEN kind = 'docs' THEN 'manual:' || split_part(path, '/', 1) WHEN kind IN ('book', 'paper') THEN hash END AS key FROM sources",
    "thin_files": """SELECT source_id, s.pages, coalesce(c.cited, 0) AS cited, coalesce(c.cited, 0) < s.pages * 0.5 AS thin FROM (SELECT source_id, source_id % 30 + 1 AS pages FROM sources) s
LEFT JOIN (SELECT source_id, count(DISTINCT page) AS cited FROM chunks GROUP BY 1) c USING (source_id)""",
    "scan_queue": "SELECT hash, path FROM (SELECT *, source_id % 40 AS pages, source_id % 17 AS done, source_id % 5 AS tries FROM sources WHERE recognised) WHERE done < pages AND tries < 3 ORDER BY tries, path, hash LIMIT 20",
    "absent_drafts": "SELECT DISTINCT hash AS key FROM sources WHERE kind IN ('book', 'paper')",
    "alias_text": """WITH k AS (SELECT DISTINCT chunk_id, source_id, ord, body FROM chunks), f AS (SELECT source_id, min(ord) AS ord FROM k GROUP BY 1)
SELECT chunk_id, length(CASE WHEN f.ord IS NOT NULL AND len(coalesce(aliases, [])) > 0 THEN body || ' ' || array_to_string(aliases, ' ') ELSE body END) AS n_chars FROM k JOIN sources USING (source_id) LEFT JOIN f ON f.source_id = k.source_id AND f.ord = k.ord""",
    "query_labels": r"""WITH l AS (SELECT DISTINCT log_id, query, hits[1] AS chunk_id FROM search_log WHERE len(hits) > 0 AND trim(coalesce(query, '')) <> ''), k AS (SELECT DISTINCT chunk_id, body FROM chunks),
w AS (SELECT log_id, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{Nd}]+')) AS q, regexp_extract_all(lower(body), '[\p{L}\p{Nd}]+') AS b FROM l JOIN k USING (chunk_id)),
s AS (SELECT log_id, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda x: list_contains(b, x))) / len(q) END AS share FROM w)
SELECT log_id, round(share, 9) AS share, CASE WHEN share = 1 THEN 'copied' ELSE 'rephrased' END AS style FROM s""",
}
