"""Queries on pages, language, identifiers and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pages as P
from quire.runtime import spread, table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def chunk_language(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks")).select("chunk_id", T.language(F.col("body")).alias("language")).distinct()


def short_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(T.too_short(F.col("body"))).select("chunk_id").distinct()


def matter_shares(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("body")
    n = spread(table(spark, d, "chunks")).select("chunk_id", T.too_short(c).alias("short"), T.line_counts(c).alias("n")).distinct()
    return n.select("chunk_id", "n.*", (F.col("short") | T.matter(F.col("n"))).alias("front_or_back"))


def readability(spark: SparkSession, d: str) -> DataFrame:
    n = spread(table(spark, d, "chunks")).select("chunk_id", T.char_counts(F.col("body")).alias("n")).distinct()
    return n.select("chunk_id", *(F.col(f"n.{k}").cast("long").alias(k) for k in ("letters", "foreign", "chars", "vowels", "shifted_chars", "shifted_vowels")), T.garbled(F.col("n")).alias("unreadable"))


def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    return P.scans(_chunks(spark, d).select("source_id", "body"), "source_id")


def printed_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.printed_pages(_chunks(spark, d).where("page IS NOT NULL").select("source_id", "page", "body"), "source_id")


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = P.page_chunks(_chunks(spark, d).select("source_id", F.col("ord").alias("page"), "body"), "source_id")
    return out.select("source_id", "ord", "page", F.length("body").alias("n_chars"))


def locators(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.locator(F.col("heading"), F.col("page"), F.col("printed_page")).alias("locator")).distinct()


def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", T.normalize_title(F.col("title")).alias("title"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").select("citation_id", T.find_doi(F.col("raw")).alias("doi"), T.find_arxiv(F.col("raw")).alias("arxiv")).distinct()


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in ("doi", "arxiv", "isbn", "title", "year", "raw")]
    return table(spark, d, "citations").select("citation_id", T.fingerprint(*cols).alias("fingerprint")).distinct()


def valid_isbns(spark: SparkSession, d: str) -> DataFrame:
    bare = F.upper(F.regexp_replace("isbn", "[^0-9Xx]", ""))
    meta = table(spark, d, "source_meta").where("isbn IS NOT NULL").select(F.lit("source_meta").alias("origin"), F.col("source_id").alias("id"), bare.alias("isbn"))
    cited = table(spark, d, "citations").where("isbn IS NOT NULL").select(F.lit("citations").alias("origin"), F.col("citation_id").alias("id"), bare.alias("isbn")).distinct()
    return meta.unionByName(cited).select("origin", "id", "isbn", T.valid_isbn(F.col("isbn")).alias("valid"))


def scan_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", T.scan_title(F.col("path")).alias("title"), T.manual_name(F.col("title")).alias("folder"))


def name_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", T.slug(F.col("title")).alias("slug"), T.plural_ru(F.col("source_id"), "файл", "файла", "файлов").alias("noun"), T.short_duration(F.col("source_id") * 977).alias("took"))


QUERIES = {f.__name__: f for f in (chunk_language, short_pages, matter_shares, readability, scanned_files, printed_pages, page_chunks, locators, normalized_titles, identifiers, fingerprints, valid_isbns, scan_titles, name_slugs)}

_WS = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _kept(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"


_SHORT = f"strlen({_strip('body')}) < 150"
_LINES = f"list_filter(string_split(body, chr(10)), lambda x: {_strip('x')} <> '')"
_MATTER = rf"""SELECT DISTINCT chunk_id, source_id, ord, body, len({_LINES}) AS n_lines,
  len(list_filter({_LINES}, lambda x: regexp_matches(x, '\.\s?\.\s?\.\s?\.'))) AS leaders,
  len(list_filter({_LINES}, lambda x: regexp_matches(x, '^\s*\S.*,\s*\d+(\s*[,–-]\s*\d+)*\s*$'))) AS entries, {_SHORT} AS short FROM chunks"""
_FRONT = "(short OR leaders > n_lines * 0.3 OR (n_lines > 10 AND entries > n_lines * 0.5))"
_MOVED = "array_to_string(list_transform(string_split(body, ''), lambda c: CASE WHEN unicode(c) BETWEEN 1 AND 126 THEN chr(unicode(c) + 29) ELSE c END), '')"
_SOLID = rf"[{_WS}\p{{Nd}}]"
_READ = rf"""SELECT DISTINCT chunk_id, {_kept('body', r'\p{L}')} AS letters,
  {_kept('body', r'\p{L}')} - {_kept('body', 'a-zA-Z')} - (length(regexp_replace(body, '[^\p{{Cyrillic}}]', '', 'g'))) AS "foreign",
  length(regexp_replace(body, '{_SOLID}', '', 'g')) AS chars, {_kept('lower(body)', T.VOWELS)} AS vowels,
  length(regexp_replace({_MOVED}, '{_SOLID}', '', 'g')) AS shifted_chars, {_kept(f'lower({_MOVED})', T.VOWELS)} AS shifted_vowels FROM chunks"""
_BAD = """((letters >= 50 AND "foreign" > letters * 0.3) OR (chars >= 50 AND vowels < chars * 0.12)
  OR (shifted_chars >= 50 AND shifted_vowels > shifted_chars * 0.25 AND shifted_vowels * chars > vowels * shifted_chars))"""
_NORM = r"trim(regexp_replace(translate(lower({0}), 'ё', 'е'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
_CAND = r"""
WITH pages AS (SELECT DISTINCT chunk_id, source_id, page, body FROM chunks WHERE page IS NOT NULL),
full_lines AS (SELECT source_id, page, list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip}), lambda x: x <> '') AS ls FROM pages),
words AS (SELECT source_id, page, string_split_regex(regexp_replace(x, '^\[\s*(\d+)\s*\]$', '\1'), '\s+') AS w
          FROM (SELECT source_id, page, unnest(CASE WHEN len(ls) <= 10 THEN ls ELSE list_concat(ls[1:5], ls[-5:]) END) AS x FROM full_lines)),
cand AS (SELECT DISTINCT source_id, page, CAST(n AS INTEGER) AS n FROM (SELECT source_id, page, unnest([w[1], w[len(w)]]) AS n FROM words) WHERE regexp_full_match(n, '[+]?\d{{1,9}}') AND CAST(n AS INTEGER) BETWEEN 1 AND 9999),
votes AS (SELECT source_id, page - n AS off, count(DISTINCT page) AS v FROM cand GROUP BY ALL),
best AS (SELECT source_id, off, v FROM votes QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY v DESC, abs(off), off) = 1),
sizes AS (SELECT source_id, count(*) AS k FROM pages GROUP BY source_id),
chosen AS (SELECT s.source_id, CASE WHEN v * 5 >= k AND (off >= 0 OR (v * 3 >= k AND v >= 3)) THEN off END AS off FROM sizes s LEFT JOIN best USING (source_id))
SELECT p.source_id, p.page, CASE WHEN off IS NOT NULL AND p.page - off >= 1 AND
  (NOT EXISTS (FROM cand c WHERE c.source_id = p.source_id AND c.page = p.page) OR EXISTS (FROM cand c WHERE c.source_id = p.source_id AND c.page = p.page AND c.n = p.page - off))
  THEN p.page - off ELSE 0 END::INTEGER AS printed FROM pages p JOIN chosen USING (source_id)""".format(strip=_strip("x"))
_SLUG = "lower(title)"
for _a, _b in T.SPELLINGS.items():
    _SLUG = f"replace({_SLUG}, '{_a}', '{_b}')"
_SLUG = f"regexp_replace(translate({_SLUG}, '{T.PLAIN[0]}', '{T.PLAIN[1]}'), '[^a-z0-9]', '', 'g')"

ORACLE = {
    "chunk_language": r"""SELECT DISTINCT chunk_id, CASE WHEN c > 0 AND c / (c + l) >= 0.25 THEN 'russian' ELSE 'english' END AS language
FROM (SELECT chunk_id, length(regexp_replace(body, '[^\p{Cyrillic}]', '', 'g')) AS c, length(regexp_replace(body, '[^\p{Latin}]', '', 'g')) AS l FROM chunks)""",
    "short_pages": f"SELECT DISTINCT chunk_id FROM chunks WHERE {_SHORT}",
    "matter_shares": f"SELECT chunk_id, n_lines, leaders, entries, {_FRONT} AS front_or_back FROM ({_MATTER})",
    "readability": f"SELECT *, {_BAD} AS unreadable FROM ({_READ})",
    "scanned_files": f"""SELECT source_id, count(*) AS pages, count(*) FILTER (NOT short AND NOT {_BAD}) AS with_text, count(*) FILTER (NOT short AND NOT {_BAD}) < count(*) * 0.5 AS scan
FROM (SELECT DISTINCT chunk_id, source_id, {_SHORT} AS short FROM chunks) JOIN ({_READ}) USING (chunk_id) GROUP BY source_id""",
    "printed_pages": _CAND,
    "page_chunks": f"""SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS ord, ord AS page, length({_strip('body')}) AS n_chars
FROM ({_MATTER}) m JOIN ({_READ}) r USING (chunk_id) WHERE NOT {_FRONT} AND NOT {_BAD}""",
    "locators": """SELECT DISTINCT chunk_id, CASE WHEN coalesce(heading, '') <> '' THEN heading WHEN coalesce(page, 0) = 0 THEN ''
 WHEN coalesce(printed_page, 0) = 0 THEN 'PDF p. ' || page WHEN printed_page <> page THEN 'с. ' || printed_page || ' (PDF ' || page || ')' ELSE 'с. ' || page END AS locator FROM chunks""",
    "normalized_titles": f"SELECT source_id, {_NORM.format('title')} AS title FROM sources",
    "identifiers": r"""SELECT DISTINCT citation_id, CASE WHEN doi <> '' AND strlen(regexp_replace(doi, '^[^/]*/', '')) >= 4 THEN doi END AS doi, nullif(arxiv, '') AS arxiv FROM
 (SELECT citation_id, regexp_replace(regexp_extract(raw, '\b(10\.\d{4,9}/[^\s"<>]+)', 1), '[.,;)\]]+$', '') AS doi,
  lower(regexp_extract(raw, '(?i)arxiv[:/\s]\s*(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+(\.[A-Z]{2})?/\d{7})', 1)) AS arxiv FROM citations)""",
    "fingerprints": f"""SELECT DISTINCT citation_id, CASE WHEN coalesce(doi, '') <> '' THEN lower(doi) WHEN coalesce(arxiv, '') <> '' THEN 'arxiv:' || arxiv WHEN coalesce(isbn, '') <> '' THEN 'isbn:' || isbn
 WHEN coalesce(title, '') <> '' AND coalesce(year, 0) <> 0 THEN {_NORM.format('title')} || '|' || year ELSE 'raw:' || {_NORM.format('raw')} END AS fingerprint FROM citations""",
    "valid_isbns": r"""WITH x AS (SELECT 'source_meta' AS origin, source_id AS id, upper(regexp_replace(isbn, '[^0-9Xx]', '', 'g')) AS isbn FROM source_meta WHERE isbn IS NOT NULL
 UNION ALL SELECT DISTINCT 'citations', citation_id, upper(regexp_replace(isbn, '[^0-9Xx]', '', 'g')) FROM citations WHERE isbn IS NOT NULL),
 y AS (SELECT *, list_transform(string_split(isbn, ''), lambda c: CASE WHEN c = 'X' THEN 10 ELSE TRY_CAST(c AS INTEGER) END) AS ds FROM x)
 SELECT origin, id, isbn, CASE WHEN regexp_full_match(isbn, '\d{9}[\dX]') THEN list_sum(list_transform(ds, lambda v, i: v * (11 - i))) % 11 = 0
  WHEN regexp_full_match(isbn, '\d{13}') THEN list_sum(list_transform(ds, lambda v, i: v * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 ELSE false END AS valid FROM y""",
    "scan_titles": r"""SELECT source_id, regexp_replace(path, '(?i)^.*/|\.pdf$', '', 'g') AS title,
 regexp_replace(regexp_replace(regexp_replace(title, '[^A-Za-z0-9_.-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS folder FROM sources""",
    "name_slugs": f"""SELECT source_id, {_SLUG} AS slug, CASE WHEN source_id % 100 BETWEEN 11 AND 14 THEN 'файлов' WHEN source_id % 10 = 1 THEN 'файл' WHEN source_id % 10 BETWEEN 2 AND 4 THEN 'файла' ELSE 'файлов' END AS noun,
 CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took
 FROM (SELECT *, source_id * 977 AS s FROM sources)""",
}
