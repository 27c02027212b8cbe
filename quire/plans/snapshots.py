"""Queries on snapshots of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import snapshots as S
from quire.plans.pages import _SLUG
from quire.runtime import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources")


def _found(spark: SparkSession, d: str) -> DataFrame:
    """What a walk finds: a seventh of the files gone, an eleventh moved, a thirteenth changed."""
    i = F.col("source_id")
    return _sources(spark, d).where(i % 7 != 0).select(
        "kind", F.when(i % 11 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(i % 13 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash")
    )


def unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    return S.unchanged(_found(spark, d), _sources(spark, d), 1)


def renamed_files(spark: SparkSession, d: str) -> DataFrame:
    return S.renamed(_found(spark, d), _sources(spark, d))


def pruned_files(spark: SparkSession, d: str) -> DataFrame:
    return S.prune(_sources(spark, d).select("source_id", "kind", "path"), _found(spark, d), "docs").select("source_id")


def cascaded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.orphans_out(_chunks(spark, d), S.prune(_sources(spark, d), _found(spark, d), "docs"), "source_id").select("chunk_id")


def retitled(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "source_meta").where("meta_title IS NOT NULL").select("source_id", F.col("meta_title").alias("new_title"))
    return S.set_titles(_sources(spark, d), new).select("source_id", "title")


def rehashed(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    moved = s.where("kind = 'paper'").select(F.col("hash").alias("old"), F.concat(F.lit("n"), F.substring("hash", 1, 6)).alias("new")).distinct()
    return S.rehash({"citations": (table(spark, d, "citations").select("citation_id", "paper").distinct(), "paper")}, moved)["citations"]


def merged_records(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d).where("kind IN ('book', 'paper')").select(F.col("source_id").alias("key"), F.concat(F.lit("k"), F.col("source_id") % 50).alias("citekey"), "title", F.col("indexed_at").alias("updated_at"))
    old = s.where("key % 2 = 0").groupBy("citekey").agg(F.min("key").alias("key")).join(s, ["citekey", "key"]).select(s.columns)
    return S.merge_newer(old, s.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY")).withColumn("title", F.upper("title"))).select("key", "citekey", "title")


def source_listing(spark: SparkSession, d: str) -> DataFrame:
    counts = S.progress(_chunks(spark, d), table(spark, d, "chunk_vectors"))
    scans = _found(spark, d).where("kind IN ('book', 'paper')").select("kind", "path")
    return S.listing(_sources(spark, d), counts, scans)


def library_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.totals(source_listing(spark, d))


def source_states(spark: SparkSession, d: str) -> DataFrame:
    p = S.progress(_chunks(spark, d), table(spark, d, "chunk_vectors")).withColumn("scan", F.lit(False))
    return p.select("source_id", "chunks", "embedded", "quarantined", S.state().alias("state"))


def manual_homes(spark: SparkSession, d: str) -> DataFrame:
    return S.manuals(_sources(spark, d))


def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    files = _sources(spark, d).where("recognised").select("hash", (F.col("source_id") % 40).cast("int").alias("pages"))
    cached = _chunks(spark, d).join(_sources(spark, d), "source_id").where("page IS NOT NULL").select("hash", "page")
    return S.missing_pages(files, cached)


def embed_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.embed_windows(_chunks(spark, d), _sources(spark, d)).select("chunk_id", "hash")


def embed_queue(spark: SparkSession, d: str) -> DataFrame:
    return S.queue(_chunks(spark, d), table(spark, d, "chunk_vectors"), 16)


def requeued(spark: SparkSession, d: str) -> DataFrame:
    return S.requeue(table(spark, d, "chunk_vectors")).select("vec_id", "attempts", "last_error")


def attempted(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chunk_vectors")
    batch = v.where("vec_id % 5 = 0").select("hash").unionByName(spark.sql("SELECT 'new' AS hash"))
    return S.attempted(v, batch).select("hash", "attempts")


def used_vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.prune_vectors(table(spark, d, "chunk_vectors"), _chunks(spark, d).where("ord % 2 = 0")).select("vec_id")


def undescribed_files(spark: SparkSession, d: str) -> DataFrame:
    described = table(spark, d, "source_meta").join(_sources(spark, d), "source_id").where("meta_title IS NOT NULL").select(F.col("hash").alias("key"))
    return S.undescribed(_sources(spark, d), _chunks(spark, d), described).select("source_id", "key", F.md5("head").alias("head"), F.md5("tail").alias("tail"))


def citekeys(spark: SparkSession, d: str) -> DataFrame:
    r = _sources(spark, d).join(table(spark, d, "source_meta"), "source_id", "left").select(
        F.col("source_id").alias("key"), F.when(F.col("source_id") % 3 == 0, F.regexp_extract("author", r"^[^\p{L}]*([\p{L}]+)", 1)).alias("family"), "title",
        F.regexp_extract("issued", r"(1[5-9]\d\d|20\d\d)", 1).try_cast("int").alias("year"), F.when(F.col("source_id") % 10 == 0, "checked").otherwise("draft").alias("status"), F.concat(F.lit("own"), "source_id").alias("citekey"),
    )
    return S.citekeys(r)


QUERIES = {f.__name__: f for f in (unchanged_files, renamed_files, pruned_files, cascaded_chunks, retitled, rehashed, merged_records, source_listing, library_totals, source_states, manual_homes, missing_pages, embed_windows, embed_queue, requeued, attempted, used_vectors, undescribed_files, citekeys)}

_F = """found AS (SELECT kind, CASE WHEN source_id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN source_id % 13 = 0 THEN hash || 'x' ELSE hash END AS hash FROM sources WHERE source_id % 7 <> 0)"""
_K = "k AS (SELECT DISTINCT chunk_id, source_id, ord, page, heading, body, embed_hash FROM chunks)"
_P = f"""{_K}, p AS (SELECT source_id, count(*) AS chunks, count(embedding) AS embedded, count(*) FILTER (embedding IS NULL AND coalesce(attempts, 0) >= 3) AS quarantined FROM k LEFT JOIN chunk_vectors v ON v.hash = k.embed_hash GROUP BY source_id)"""
_L = f"""{_F}, {_P}, l AS (SELECT kind, path, title, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded, false AS scan FROM sources LEFT JOIN p USING (source_id)
 UNION ALL SELECT kind, path, regexp_replace(path, '(?i)^.*/|\\.pdf$', '', 'g'), 0, 0, true FROM found WHERE kind IN ('book', 'paper') AND (kind, path) NOT IN (SELECT (kind, path) FROM sources))"""
ORACLE = {
    "unchanged_files": f"WITH {_F} SELECT f.kind, f.path FROM found f JOIN sources s ON s.kind = f.kind AND s.path = f.path AND s.hash = f.hash AND s.rules >= 1",
    "renamed_files": f"""WITH {_F}, gone AS (SELECT * FROM sources s WHERE NOT EXISTS (FROM found f WHERE f.kind = s.kind AND f.path = s.path) QUALIFY row_number() OVER (PARTITION BY kind, hash ORDER BY path) = 1)
SELECT source_id, min(f.path) AS path FROM gone JOIN found f ON f.kind = gone.kind AND f.hash = gone.hash WHERE NOT EXISTS (FROM sources s WHERE s.kind = f.kind AND s.path = f.path) GROUP BY source_id""",
    "pruned_files": f"WITH {_F} SELECT source_id FROM sources s WHERE kind <> 'docs' OR EXISTS (FROM found f WHERE f.kind = s.kind AND f.path = s.path)",
    "cascaded_chunks": f"WITH {_F} SELECT DISTINCT chunk_id FROM chunks JOIN sources s USING (source_id) WHERE kind <> 'docs' OR EXISTS (FROM found f WHERE f.kind = s.kind AND f.path = s.path)",
    "retitled": "SELECT source_id, coalesce(meta_title, title) AS title FROM sources LEFT JOIN source_meta USING (source_id)",
    "rehashed": """WITH m AS (SELECT DISTINCT hash AS old, 'n' || left(hash, 6) AS new FROM sources WHERE kind = 'paper'), c AS (SELECT * FROM m WHERE new IN (SELECT new FROM m GROUP BY new HAVING count(*) = 1))
SELECT citation_id, coalesce(new, paper) AS paper FROM (SELECT DISTINCT citation_id, paper FROM citations) LEFT JOIN c ON old = paper""",
    "merged_records": """WITH s AS (SELECT source_id AS key, 'k' || (source_id % 50) AS citekey, title FROM sources WHERE kind IN ('book', 'paper')), o AS (SELECT citekey, min(key) AS key FROM s WHERE key % 2 = 0 GROUP BY citekey)
SELECT s.key, s.citekey, upper(title) AS title FROM s WHERE s.key IN (SELECT key FROM o) OR s.citekey NOT IN (SELECT citekey FROM o)""",
    "source_listing": f"WITH {_L} SELECT * FROM l",
    "library_totals": f"WITH {_L} SELECT kind, count(*) AS files, sum(chunks) AS chunks, sum(embedded) AS embedded FROM l GROUP BY kind",
    "source_states": f"""WITH {_P} SELECT *, CASE WHEN chunks = 0 THEN 'waiting' WHEN embedded + quarantined < chunks THEN 'embedding' WHEN quarantined > 0 THEN 'errors' ELSE 'ready' END AS state FROM p""",
    "manual_homes": r"""SELECT split_part(path, '/', 1) AS site, count(*) AS pages, arg_min(path, {'a': NOT regexp_matches(path, '(^|/)index\.html$'), 'b': len(string_split(path, '/')), 'c': path}) AS home, max(indexed_at) AS indexed_at FROM sources WHERE kind = 'docs' GROUP BY 1""",
    "missing_pages": f"""WITH {_K} SELECT * FROM (SELECT hash, CAST(unnest(range(1, CAST(source_id % 40 AS BIGINT) + 1)) AS INTEGER) AS page FROM sources WHERE recognised) x WHERE (hash, page) NOT IN (SELECT (hash, page) FROM k JOIN sources USING (source_id) WHERE page IS NOT NULL)""",
    "embed_windows": f"""WITH {_K} SELECT chunk_id, sha256(concat_ws(' ', CASE WHEN kind = 'vault' THEN concat_ws(' > ', nullif(title, ''), nullif(heading, '')) END, nullif(right(lag(body) OVER w, 500), ''), left(body, 5000), nullif(left(lead(body) OVER w, 500), ''))) AS hash
FROM k JOIN sources USING (source_id) WINDOW w AS (PARTITION BY source_id ORDER BY ord)""",
    "embed_queue": f"""WITH {_K}, q AS (SELECT source_id, ord, embed_hash AS hash FROM k LEFT JOIN chunk_vectors v ON v.hash = k.embed_hash WHERE embedding IS NULL AND coalesce(attempts, 0) < 3)
SELECT hash, source_id, min(ord) AS ord FROM q WHERE source_id = (SELECT min(source_id) FROM q) GROUP BY ALL ORDER BY ord, hash LIMIT 16""",
    "requeued": "SELECT vec_id, CASE WHEN embedding IS NULL AND attempts >= 3 THEN 0 ELSE attempts END AS attempts, CASE WHEN embedding IS NULL AND attempts >= 3 THEN NULL ELSE last_error END AS last_error FROM chunk_vectors",
    "attempted": "SELECT hash, CASE WHEN vec_id % 5 = 0 THEN coalesce(attempts, 0) + 1 ELSE attempts END AS attempts FROM chunk_vectors UNION ALL SELECT 'new', 1",
    "used_vectors": "SELECT vec_id FROM chunk_vectors WHERE hash IN (SELECT embed_hash FROM chunks WHERE ord % 2 = 0)",
    "undescribed_files": f"""WITH {_K}, o AS (SELECT source_id, hash AS key FROM sources WHERE kind IN ('book', 'paper') AND hash NOT IN (SELECT hash FROM sources JOIN source_meta USING (source_id) WHERE meta_title IS NOT NULL)),
n AS (SELECT source_id, ord, body, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS a, row_number() OVER (PARTITION BY source_id ORDER BY ord DESC) AS z FROM k)
SELECT o.source_id, key, md5(string_agg(body, chr(10) ORDER BY ord) FILTER (a <= 8)) AS head, md5(string_agg(body, chr(10) ORDER BY ord) FILTER (z <= 4)) AS tail FROM o LEFT JOIN n USING (source_id) GROUP BY ALL""",
    "citekeys": rf"""WITH r AS (SELECT source_id AS key, CASE WHEN source_id % 3 = 0 THEN regexp_extract(author, '^[^\p{{L}}]*([\p{{L}}]+)', 1) END AS family, title AS t, TRY_CAST(regexp_extract(issued, '(1[5-9]\d\d|20\d\d)', 1) AS INTEGER) AS year, source_id FROM sources LEFT JOIN source_meta USING (source_id)),
n AS (SELECT *, coalesce(nullif(trim(family), ''), list_filter(string_split_regex(trim(t), '\s+'), lambda w: lower(w) NOT IN ('the', 'a', 'an', 'on', 'of', 'and'))[1], '') AS title FROM r),
b AS (SELECT key, CASE WHEN x = '' THEN 'ref' ELSE x END AS base FROM (SELECT key, {_SLUG} || coalesce(CAST(nullif(year, 0) AS VARCHAR), '') AS x FROM n)),
d AS (SELECT key, base, row_number() OVER (PARTITION BY base ORDER BY key) AS i FROM b WHERE key % 10 <> 0)
SELECT key, base || CASE WHEN i = 1 THEN '' ELSE chr(CAST(least(i - 2, 25) + 97 AS INTEGER)) END AS citekey FROM d UNION ALL SELECT key, 'own' || key FROM b WHERE key % 10 = 0""",
}
