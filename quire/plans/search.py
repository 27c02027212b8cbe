"""Search queries over chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import search as S
from quire.runtime import materialise, spread, table

#: The search terms and the query vector of the registered queries.
AND, PHRASE, NOT = "ordered partitions ledger", '"cost-based partition"', "ledger -cursor"
VECTOR = [((i * 37) % 17 - 8) / 8 for i in range(64)]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _index(spark: SparkSession, d: str, q: S.Query, stemmed: bool = False) -> DataFrame:
    """The postings of the query's terms; with a stored index this is a filter of it."""
    lang = T.language(F.col("body")) if stemmed else F.lit("simple")
    texts = spread(table(spark, d, "chunks")).select("chunk_id", lang.alias("lang"), "body")
    some = S.postings(texts, stemmed, S.query_terms(q, stemmed)).withColumn("positions", F.array_distinct("positions"))  # repeated deliveries
    return materialise(some, "postings")


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return S.document_frequency(S.postings(_chunks(spark, d).select("chunk_id", F.lit("simple").alias("lang"), "body")))


def _matched(spark: SparkSession, d: str, q: str) -> DataFrame:
    return S.match(_index(spark, d, S.Query(q)), S.parse(q))


def text_and(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, AND)


def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, PHRASE)


def text_not(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, NOT)


def text_or(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, "harness or pipeline")


def text_topk(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed, each chunk in its own language, ranked by cover density, titles and aliases boosted."""
    q = S.Query("adaptive catalogues", limit=20)
    return S.text_search(_index(spark, d, q, True), _chunks(spark, d), table(spark, d, "sources"), q, stemmed=True)


def text_kind_tag(spark: SparkSession, d: str) -> DataFrame:
    hits = S.filtered(_chunks(spark, d).select("chunk_id", "source_id", "tags"), table(spark, d, "sources"), "vault", "nlp")
    return hits.select("chunk_id", "path")


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under each tag and each tag above it."""
    tags = _chunks(spark, d).select("chunk_id", F.explode("tags").alias("tag")).select("chunk_id", F.split(F.lower("tag"), "/").alias("p"))
    up = tags.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("tag"))
    return up.distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n_chunks"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(table(spark, d, "chunk_vectors"), VECTOR, 20)


def vector_topk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(table(spark, d, "embeddings"), VECTOR, 20)


def vector_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the chunks of one kind, exactly; one vector may give several chunks."""
    q = S.Query("", kind="docs", limit=20, vector=VECTOR)
    return S.vector_chunks(table(spark, d, "chunk_vectors"), _chunks(spark, d), table(spark, d, "sources"), q)


def vector_tag(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the chunks under one tag or a tag below it, exactly."""
    q = S.Query("", tag="nlp", limit=20, vector=VECTOR)
    return S.vector_chunks(table(spark, d, "chunk_vectors"), _chunks(spark, d), table(spark, d, "sources"), q)


def _legs(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = table(spark, d, "documents")
    one = docs.select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("rank")).orderBy(F.desc("rank"), "chunk_id").limit(40)
    two = docs.select(F.col("doc_id").alias("chunk_id"), F.octet_length("text").cast("double").alias("rank")).orderBy(F.desc("rank"), "chunk_id").limit(40)
    return [S.positions(one), S.positions(two)]


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_legs(spark, d)).select("chunk_id", F.round("rank", 9).alias("rank"))


def per_source_cap(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), F.col("n_chars").alias("rank"))
    return S.cap_per_source(hits, 3)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    q = S.Query("adaptive catalogues", limit=20, per_source=2, vector=VECTOR)
    hits = S.hybrid(_index(spark, d, q, True), table(spark, d, "chunk_vectors"), _chunks(spark, d), table(spark, d, "sources"), q, stemmed=True)
    return hits.select("chunk_id", "path", F.round("rank", 9).alias("rank"), "snippet")


def compare_legs(spark: SparkSession, d: str) -> DataFrame:
    q = S.Query("adaptive catalogues", limit=10, vector=VECTOR)
    lists = S.compare(_index(spark, d, q, True), table(spark, d, "chunk_vectors"), _chunks(spark, d), table(spark, d, "sources"), q, stemmed=True)
    out = None
    for name, hits in lists.items():
        one = hits.select(F.lit(name).alias("leg"), "pos", "chunk_id")
        out = one if out is None else out.unionByName(one)
    return out


def passages(spark: SparkSession, d: str) -> DataFrame:
    p = S.passages(_chunks(spark, d).select("chunk_id", "source_id", "ord", "body"))
    return p.select("chunk_id", F.md5("body").alias("body"), F.md5("previous").alias("previous"), F.md5("next").alias("next"))


def read_passage(spark: SparkSession, d: str) -> DataFrame:
    return S.read_passage(table(spark, d, "chunks"), 100).select("chunk_id", "body", "previous", "next")


def bodies_by_id(spark: SparkSession, d: str) -> DataFrame:
    return S.bodies(table(spark, d, "chunks"), [1, 5, 100, 190], 240)


QUERIES = {f.__name__: f for f in (term_df, text_and, text_phrase, text_not, text_or, text_topk, text_kind_tag, tag_counts, vector_topk, vector_topk_embeddings, vector_tagged, vector_tag, rrf_fuse, per_source_cap, hybrid_search, compare_legs, passages, read_passage, bodies_by_id)}

_TOK = r"""WITH d AS (SELECT DISTINCT chunk_id, body FROM chunks), t AS (SELECT chunk_id, regexp_extract_all(lower(body), '[\p{L}\p{Nd}]+') AS ws FROM d)"""
_VEC = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"
_COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {_VEC}), 6)"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE = {
    "term_df": _TOK + " SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM t) GROUP BY term",
    "text_and": _TOK + " SELECT chunk_id FROM t WHERE list_contains(ws, 'ordered') AND list_contains(ws, 'partitions') AND list_contains(ws, 'ledger')",
    "text_phrase": _TOK + " SELECT DISTINCT chunk_id FROM (SELECT chunk_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t) WHERE ws[i] = 'cost' AND ws[i + 1] = 'based' AND ws[i + 2] = 'partition'",
    "text_not": _TOK + " SELECT chunk_id FROM t WHERE list_contains(ws, 'ledger') AND NOT list_contains(ws, 'cursor')",
    "text_or": _TOK + " SELECT chunk_id FROM t WHERE list_contains(ws, 'harness') OR list_contains(ws, 'pipeline')",
    "text_kind_tag": """SELECT DISTINCT c.chunk_id, s.path FROM chunks c JOIN sources s USING (source_id)
WHERE s.kind = 'vault' AND len(list_filter(c.tags, lambda t: lower(t) = 'nlp' OR starts_with(lower(t), 'nlp/'))) > 0""",
    "tag_counts": """WITH x AS (SELECT DISTINCT chunk_id, unnest(tags) AS tag FROM chunks), p AS (SELECT chunk_id, string_split(lower(tag), '/') AS p FROM x),
u AS (SELECT DISTINCT chunk_id, array_to_string(p[1:n], '/') AS tag FROM (SELECT chunk_id, p, unnest(range(1, len(p) + 1)) AS n FROM p)) SELECT tag, count(*) AS n_chunks FROM u GROUP BY tag""",
    "vector_topk": f"SELECT vec_id, {_COS} AS rank FROM chunk_vectors WHERE {_USABLE} ORDER BY rank DESC, vec_id LIMIT 20",
    "vector_topk_embeddings": f"SELECT vec_id, {_COS} AS rank FROM embeddings WHERE {_USABLE} ORDER BY rank DESC, vec_id LIMIT 20",
    "vector_tagged": f"""SELECT c.chunk_id, {_COS} AS rank FROM (SELECT DISTINCT chunk_id, source_id, embed_hash FROM chunks) c JOIN sources s USING (source_id) JOIN chunk_vectors v ON v.hash = c.embed_hash
WHERE s.kind = 'docs' AND {_USABLE} ORDER BY rank DESC, chunk_id LIMIT 20""",
    "vector_tag": f"""SELECT c.chunk_id, {_COS} AS rank FROM (SELECT DISTINCT chunk_id, tags, embed_hash FROM chunks) c JOIN chunk_vectors v ON v.hash = c.embed_hash
WHERE len(list_filter(c.tags, lambda t: lower(t) = 'nlp' OR starts_with(lower(t), 'nlp/'))) > 0 AND {_USABLE} ORDER BY rank DESC, chunk_id LIMIT 20""",
    "rrf_fuse": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) AS i FROM documents)
SELECT doc_id AS chunk_id, round(sum(1.0::DOUBLE / (60 + i)), 9) AS rank FROM (FROM a WHERE i <= 40 UNION ALL FROM b WHERE i <= 40) GROUP BY doc_id""",
    "per_source_cap": "SELECT doc_id AS chunk_id, source AS path, n_chars AS rank FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3",
    "passages": """SELECT chunk_id, md5(body) AS body, md5(lag(body) OVER w) AS previous, md5(lead(body) OVER w) AS next FROM (SELECT DISTINCT chunk_id, source_id, ord, body FROM chunks) WINDOW w AS (PARTITION BY source_id ORDER BY ord)""",
    "read_passage": """SELECT * FROM (SELECT chunk_id, body, lag(body) OVER w AS previous, lead(body) OVER w AS next FROM (SELECT DISTINCT chunk_id, source_id, ord, body FROM chunks) WINDOW w AS (PARTITION BY source_id ORDER BY ord)) WHERE chunk_id = 100""",
    "bodies_by_id": "SELECT DISTINCT chunk_id, left(body, 240) AS body FROM chunks WHERE chunk_id IN (1, 5, 100, 190)",
}
