"""Citation graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import graph as G
from quire.plans.pages import _NORM
from quire.runtime import materialise, table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").dropDuplicates(["citation_id"])
    return c.withColumn("fingerprint", T.fingerprint(*[F.col(x) for x in ("doi", "arxiv", "isbn", "title", "year", "raw")]))


def first_page_heads(spark: SparkSession, d: str) -> DataFrame:
    return G.first_pages(_chunks(spark, d))


def best_sources(spark: SparkSession, d: str) -> DataFrame:
    return G.best_sources(table(spark, d, "sources")).select("hash", "source_id", "kind", "path")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources").where("kind IN ('book', 'paper')")
    described = sources.join(table(spark, d, "source_meta"), "source_id").select(
        F.col("hash").alias("key"), "kind", F.lit(None).cast("string").alias("doi"), "isbn", "title", F.regexp_extract("issued", r"(1[5-9]\d\d|20\d\d)", 1).try_cast("int").alias("year")
    )
    heads = G.first_pages(_chunks(spark, d)).join(sources.select("source_id", "hash"), "source_id").select("hash", "head")
    return G.resolve(table(spark, d, "citations"), described, heads, table(spark, d, "sources"))


def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


def citations_of(spark: SparkSession, d: str) -> DataFrame:
    out = G.citations_of(_citations(spark, d), materialise(_resolved(spark, d), "resolved"), table(spark, d, "sources"))
    return out.select("citation_id", "resolved", "matched_by", "source_kind", "source_path")


def citing(spark: SparkSession, d: str) -> DataFrame:
    return G.citing(_citations(spark, d), table(spark, d, "sources"), "fingerprint")


def shared_citations(spark: SparkSession, d: str) -> DataFrame:
    """Entries of reference lists whose work is in some paper's list of primary studies too."""
    c = _citations(spark, d)
    return G.shared(c.where("list = 'references'"), c.where("list <> 'references'")).select("citation_id")


def cited_together(spark: SparkSession, d: str) -> DataFrame:
    return G.coupling(_citations(spark, d))


def unparsed_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers without entries read since 2024 count as unread."""
    parsed = table(spark, d, "citations").groupBy("paper").agg(F.max("parsed_at").alias("at")).select("paper", F.when(F.col("at") >= F.lit("2024-01-01").cast("timestamp_ntz"), 6).otherwise(5).alias("parser"))
    return G.unparsed(table(spark, d, "sources"), parsed, 6)


def replaced_entries(spark: SparkSession, d: str) -> DataFrame:
    old = _citations(spark, d).select("citation_id", "paper", "list", "ord", "title", "year")
    again = old.where("ord <= 5 AND year < 2000").select(F.col("citation_id") + 1_000_000_000, "paper", "list", "ord", F.lit("").alias("title"), F.lit(0).alias("year")).toDF(*old.columns)
    return G.replace_entries(old, again)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a DOI but no title, authors, container or year take them from other entries with the same DOI."""
    c = _citations(spark, d)
    known = c.where("doi IS NOT NULL").groupBy("doi").agg(F.max("title").alias("title"), F.max("authors").alias("authors"), F.max("container").alias("container"), F.max("year").alias("year"))
    return G.enrich(c.where("doi IS NOT NULL"), known).select("citation_id", "title", "authors", "container", "year")


def note_citations(spark: SparkSession, d: str) -> DataFrame:
    """Notes made of the library's titles, each cited with a page."""
    s = table(spark, d, "sources")
    notes = s.where("kind = 'vault'").select(F.col("path").alias("note"), F.concat(F.lit("*"), F.col("title"), F.lit("*, с. 12")).alias("text"))
    more = s.where("kind = 'book'").select(F.concat(F.lit("n"), F.col("source_id") % 7).alias("note"), F.concat(F.lit("see *"), F.regexp_replace("title", r"[*:].*$", ""), F.lit("* с. 3")).alias("text"))
    found = G.note_citations(notes.unionByName(more), s.where("kind = 'book'").select(F.col("source_id").alias("place"), "title"))
    return G.tally(found)


QUERIES = {f.__name__: f for f in (first_page_heads, best_sources, resolve_citations, citations_of, citing, shared_citations, cited_together, unparsed_papers, replaced_entries, enriched, note_citations)}

_NB = _NORM.format("body")
_C = f"""c AS (SELECT DISTINCT ON (citation_id) *, CASE WHEN coalesce(doi, '') <> '' THEN lower(doi) WHEN coalesce(arxiv, '') <> '' THEN 'arxiv:' || arxiv WHEN coalesce(isbn, '') <> '' THEN 'isbn:' || isbn
 WHEN coalesce(title, '') <> '' AND coalesce(year, 0) <> 0 THEN {_NORM.format('title')} || '|' || year ELSE 'raw:' || {_NORM.format('raw')} END AS fingerprint FROM citations)"""
_BEST = "best AS (SELECT hash, source_id, kind, path FROM sources WHERE kind IN ('book', 'paper') QUALIFY row_number() OVER (PARTITION BY hash ORDER BY kind <> 'paper', path, source_id) = 1)"
_HEADS = f"""heads AS (SELECT source_id, left({_NORM.format("string_agg(body, ' ' ORDER BY ord)")}, 600) AS head FROM (SELECT DISTINCT chunk_id, source_id, page, ord, body FROM chunks WHERE page IS NOT NULL) x
 WHERE page = (SELECT min(page) FROM chunks y WHERE y.source_id = x.source_id) GROUP BY source_id)"""
_RES = rf"""{_HEADS}, {_BEST},
e AS (SELECT DISTINCT paper, list, ord, isbn, year, {_NORM.format('title')} AS t FROM citations),
d AS (SELECT s.hash AS key, s.kind, regexp_replace(m.isbn, '[^0-9Xx]', '', 'g') AS isbn, {_NORM.format('s.title')} AS t, TRY_CAST(regexp_extract(issued, '(1[5-9]\d\d|20\d\d)', 1) AS INTEGER) AS year FROM sources s JOIN source_meta m USING (source_id) WHERE s.kind IN ('book', 'paper')),
cand AS (SELECT paper, list, ord, key, 2 AS r, 'isbn' AS way FROM e JOIN d ON e.isbn <> '' AND d.isbn <> '' AND d.kind = 'book' AND length(e.isbn) IN (10, 13) AND contains(d.isbn, e.isbn)
 UNION SELECT paper, list, ord, key, 3, 'title' FROM e JOIN d ON e.t = d.t AND e.year = d.year AND e.t <> ''
 UNION SELECT paper, list, ord, s.hash, 4, 'page' FROM e JOIN heads h ON len(string_split(e.t, ' ')) >= 4 AND contains(h.head, e.t) JOIN sources s ON s.source_id = h.source_id AND s.kind IN ('book', 'paper')),
picked AS (SELECT paper, list, ord, key, way FROM cand LEFT JOIN best ON best.hash = key WHERE key <> paper
 QUALIFY row_number() OVER (PARTITION BY paper, list, ord ORDER BY r, coalesce(best.kind <> 'paper', true), best.path NULLS FIRST, key) = 1),
res AS (SELECT DISTINCT c.paper, c.list, c.ord, key AS resolved, way AS matched_by FROM citations c LEFT JOIN picked USING (paper, list, ord))"""

ORACLE = {
    "first_page_heads": f"WITH {_HEADS} SELECT * FROM heads",
    "best_sources": f"WITH {_BEST} SELECT * FROM best",
    "resolve_citations": f"WITH {_RES} SELECT * FROM res",
    "citations_of": f"WITH {_C}, {_RES} SELECT citation_id, resolved, matched_by, best.kind AS source_kind, best.path AS source_path FROM c LEFT JOIN res USING (paper, list, ord) LEFT JOIN best ON best.hash = resolved",
    "citing": f"WITH {_C}, {_BEST} SELECT fingerprint, paper, entries, best.path FROM (SELECT fingerprint, paper, count(*) AS entries FROM c GROUP BY ALL) LEFT JOIN best ON best.hash = paper",
    "shared_citations": f"WITH {_C} SELECT citation_id FROM c WHERE list = 'references' AND fingerprint IN (SELECT fingerprint FROM c WHERE list <> 'references')",
    "cited_together": f"WITH {_C} SELECT fingerprint, count(DISTINCT paper) AS papers FROM c GROUP BY fingerprint HAVING count(DISTINCT paper) >= 2",
    "unparsed_papers": """SELECT hash, min(path) AS path FROM sources WHERE kind = 'paper' AND hash NOT IN (SELECT paper FROM citations GROUP BY paper HAVING max(parsed_at) >= TIMESTAMP '2024-01-01') GROUP BY hash""",
    "replaced_entries": f"""WITH {_C}, again AS (SELECT citation_id + 1000000000 AS citation_id, paper, list, ord, NULL::VARCHAR AS title, NULL::INTEGER AS year FROM c WHERE ord <= 5 AND year < 2000)
SELECT citation_id, paper, list, ord, title, year FROM c WHERE paper NOT IN (SELECT paper FROM again) UNION ALL SELECT * FROM again""",
    "enriched": f"""WITH {_C}, k AS (SELECT lower(doi) AS k, max(title) AS t, max(authors) AS a, max(container) AS o, max(year) AS y FROM c WHERE doi IS NOT NULL GROUP BY 1)
SELECT citation_id, coalesce(nullif(title, ''), t) AS title, coalesce(nullif(authors, ''), a) AS authors, coalesce(nullif(container, ''), o) AS container, coalesce(nullif(year, 0), y) AS year FROM c JOIN k ON lower(doi) = k""",
    "note_citations": r"""WITH n AS (SELECT path AS note, title AS cited FROM sources WHERE kind = 'vault' UNION ALL SELECT 'n' || (source_id % 7), regexp_replace(title, '[*:].*$', '') FROM sources WHERE kind = 'book'),
m AS (SELECT note, row_number() OVER () AS i, cited FROM n WHERE length(cited) >= 5 AND NOT contains(cited, '*') AND NOT contains(cited, chr(10))),
f AS (SELECT m.i, min_by(s.title, s.source_id) AS title FROM m JOIN sources s ON s.kind = 'book' AND starts_with(lower(s.title), lower(m.cited)) AND NOT regexp_matches(substr(s.title, length(m.cited) + 1, 1), '[\p{L}\p{Nd}]') GROUP BY m.i)
SELECT count(*) AS citations, count(f.title) AS library, count(DISTINCT f.title) AS sources, count(DISTINCT CASE WHEN f.title IS NOT NULL THEN note END) AS notes FROM m LEFT JOIN f USING (i)""",
}
