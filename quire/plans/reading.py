"""Queries that read: entries and lists of references, records, sections, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import bibliography as B
from quire.operators import references as R
from quire.operators import snapshots as S
from quire.sources import markup
from quire.runtime import table


def parsed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every printed entry read again."""
    c = table(spark, d, "citations").select(F.col("citation_id").alias("id"), "raw").distinct()
    return R.parse_entries(c).select("id", "label", "doi", "authors", "title", "year", "fingerprint")


def entry_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and DOIs only, which SQL can read too."""
    return parsed_entries(spark, d).select("id", "label", "doi")


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """(paper, pages): papers whose last page prints their entries under a heading, and an appendix after it."""
    c = table(spark, d, "citations").dropDuplicates(["citation_id"]).where("list = 'references'")
    w = Window.partitionBy("paper").orderBy("ord", "citation_id")
    lines = c.select("paper", F.concat(F.lit("["), F.row_number().over(w), F.lit("] "), F.regexp_replace("raw", r"^(\[[A-Z]{0,3}\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.)?\s*", "")).alias("line"), F.row_number().over(w).alias("n"))
    text = lines.groupBy("paper").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: F.regexp_replace(x.line, r"\s+", " ")), "\n").alias("t"))
    return text.select("paper", F.array(F.lit("A page of text.\n"), F.concat(F.lit("More.\nReferences\n"), F.col("t"), F.lit("\nAppendix A\nnotes"))).alias("pages"))


def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists cut out of papers."""
    return R.read_lists(_printed(spark, d)).select("paper", "list", "ord", F.md5("raw").alias("raw"))


def paper_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of papers without their lists: only text before and after them is left."""
    return R.paper_pages(_printed(spark, d)).select("paper", "page", F.regexp_replace("body", r"\n+", " ").alias("body"))


def record_drafts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("kind IN ('book', 'paper')")
    none = spark.createDataFrame([], "key string")
    text = S.undescribed(s, table(spark, d, "chunks").dropDuplicates(["chunk_id"]), none).select("source_id", "head", "tail")
    files = s.join(table(spark, d, "source_meta").select("source_id", "author"), "source_id", "left").join(text, "source_id")
    return B.drafts(files)


def biblatex(spark: SparkSession, d: str) -> DataFrame:
    r = record_drafts(spark, d).select(F.concat(F.lit("s"), "source_id").alias("citekey"), "csl")
    return B.biblatex_entries(r)


def csl_records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("kind IN ('book', 'paper')")
    csl = F.to_json(F.struct(F.lit("book").alias("type"), F.struct(F.array(F.array(F.year("indexed_at"), F.month("indexed_at"))).alias("date-parts")).alias("issued")))
    r = B.csl_json(s.select(F.concat(F.lit("s"), "source_id").alias("citekey"), csl.alias("csl")))
    return r.select("citekey", "csl", B.csl_year("csl").alias("year"))


def note_parts(spark: SparkSession, d: str) -> DataFrame:
    """Long sections of notes and manuals cut at blank lines."""
    kinds = table(spark, d, "sources").where("kind IN ('vault', 'docs')").select("source_id")
    rows = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).join(kinds, "source_id").select("chunk_id", "body")

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(i, n, len(p)) for i, t in zip(b["chunk_id"], b["body"], strict=True) for n, p in enumerate(markup.split_section(t or ""), 1)]
            yield pd.DataFrame(out, columns=["chunk_id", "part", "n_chars"])

    return rows.mapInPandas(run, "chunk_id long, part int, n_chars int")


QUERIES = {f.__name__: f for f in (parsed_entries, entry_labels, reference_lists, paper_pages, record_drafts, biblatex, csl_records, note_parts)}

ORACLE = {
    "entry_labels": r"""SELECT DISTINCT citation_id AS id, nullif(regexp_extract(raw, '^\s*(\[[A-Z]{0,3}\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.)\s+\S', 1), '') AS label,
 CASE WHEN d <> '' AND strlen(regexp_replace(d, '^[^/]*/', '')) >= 4 THEN d END AS doi FROM (SELECT *, regexp_replace(regexp_extract(raw, '\b10\.\d{4,9}/[^\s"<>]+'), '[.,;)\]]+$', '') AS d FROM citations)""",
    "paper_pages": r"""WITH c AS (SELECT DISTINCT ON (citation_id) paper, citation_id, regexp_replace(regexp_replace(raw, '^(\[[A-Z]{0,3}\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.)?\s*', ''), '\s+', ' ', 'g') AS raw FROM citations WHERE list = 'references'),
p AS (SELECT paper, count(*) > 1 OR sum(strlen(trim(raw))) + 4 >= 100 AS is_list, min(raw) AS one FROM c GROUP BY paper)
SELECT paper, 1::INTEGER AS page, 'A page of text. ' AS body FROM p UNION ALL SELECT paper, 2::INTEGER, CASE WHEN is_list THEN 'More. Appendix A notes' ELSE 'More. References [1] ' || one || ' Appendix A notes' END FROM p""",
    "csl_records": """SELECT 's' || source_id AS citekey, '{"id":"s' || source_id || '","type":"book","issued":{"date-parts":[[' || year(indexed_at) || ',' || month(indexed_at) || ']]}}' AS csl, year(indexed_at)::INTEGER AS year FROM sources WHERE kind IN ('book', 'paper')""",
    "reference_lists": r"""WITH c AS (SELECT DISTINCT ON (citation_id) paper, ord, citation_id, regexp_replace(regexp_replace(raw, '^(\[[A-Z]{0,3}\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.)?\s*', ''), '\s+', ' ', 'g') AS raw FROM citations WHERE list = 'references')
SELECT paper, 'references' AS list, n::INTEGER AS ord, md5(trim(regexp_replace('[' || n || '] ' || raw, '\s+\d{1,4}(,\s*\d{1,4})+\s*$', ''))) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY ord, citation_id) AS n FROM c) WHERE paper IN (SELECT paper FROM c GROUP BY paper HAVING count(*) > 1 OR sum(strlen(trim(raw))) + 4 >= 100)""",
}
