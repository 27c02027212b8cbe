"""Pages of a file: which have text, what number is printed on them, and how they become chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.runtime import ranged_row_number

EDGE_LINES = 5
MAX_FOLIO = 9999


def page_rules(pages: DataFrame, body: str = "body") -> DataFrame:
    """Adds too_short, front_or_back, unreadable and has_text."""
    c = F.col(body)
    return pages.withColumn("too_short", T.too_short(c)).withColumn("front_or_back", T.front_or_back(c)).withColumn("unreadable", T.unreadable(c)).withColumn("has_text", ~F.col("too_short") & ~F.col("unreadable"))


def scans(pages: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, pages, with_text, scan): a file with text on less than half its pages is a scan."""
    c = F.col(body)
    text = ~T.too_short(c) & ~T.unreadable(c)
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.count_if(text).alias("with_text")).withColumn("scan", F.col("with_text") < F.col("pages") * 0.5)


def folio_candidates(c):
    """Plain numbers at either end of the five lines at the top and at the bottom; a line that is a number in brackets counts as the number."""
    full = F.filter(F.transform(F.split(c, "\n", -1), T.strip), lambda x: x != "")
    n = F.size(full)
    edge = F.filter(F.transform(full, lambda x, i: F.when((i < EDGE_LINES) | (i >= n - EDGE_LINES), x)), lambda x: x.isNotNull())
    bare = F.transform(edge, lambda x: F.regexp_replace(x, r"^\[\s*(\d+)\s*\]$", "$1"))
    words = F.transform(bare, lambda x: F.split(x, r"\s+"))
    ends = F.flatten(F.transform(words, lambda w: F.array(F.get(w, F.lit(0)), F.get(w, F.size(w) - 1))))
    numbers = F.transform(F.filter(ends, lambda x: x.rlike(r"^[+]?\d{1,9}$")), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: (x > 0) & (x <= MAX_FOLIO)))


def printed_pages(pages: DataFrame, key: str, page: str = "page", body: str = "body") -> DataFrame:
    """(key, page, printed): the number printed on each page, 0 if unknown.

    Every page votes once for each offset between its place and a number on it. The commonest offset (then the one
    nearest zero, then the smaller) holds if a fifth of the pages agree; if numbers run ahead of the pages, a third
    and at least three must. Expressed as aggregations; a long file is spread over its pages.
    """
    cand = pages.select(key, page, folio_candidates(F.col(body)).alias("cand"))
    votes = cand.select(key, page, F.explode("cand").alias("n")).select(key, page, (F.col(page) - F.col("n")).alias("offset")).groupBy(key, "offset").agg(F.count_distinct(page).alias("votes"))
    best = votes.groupBy(key).agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.abs("offset"), -F.col("offset"))).alias("b"))
    sizes = cand.groupBy(key).agg(F.count(F.lit(1)).alias("pages"))
    chosen = sizes.join(best, key, "left").select(
        key,
        F.when((F.col("b.votes") * 5 >= F.col("pages")) & ((F.col("b.offset") >= 0) | ((F.col("b.votes") * 3 >= F.col("pages")) & (F.col("b.votes") >= 3))), F.col("b.offset")).alias("offset"),
    )
    number = F.col(page) - F.col("offset")
    agrees = F.array_contains("cand", number) | (F.size("cand") == 0)
    return cand.join(chosen, key).select(key, page, F.when(number.isNotNull() & (number >= 1) & agrees, number).otherwise(0).cast("int").alias("printed"))


def page_chunks(pages: DataFrame, key: str, page: str = "page", body: str = "body") -> DataFrame:
    """(key, ord, page, body): pages worth keeping, stripped, numbered from 1 in order."""
    c = F.col(body)
    kept = pages.where(~T.front_or_back(c) & ~T.unreadable(c)).select(key, page, T.strip(c).alias("body"))
    return ranged_row_number(kept, key, page, "ord").select(key, "ord", page, "body")


def thin(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, pages, cited, thin): files of which chunks cite less than half the pages. files: source_id, pages."""
    cited = chunks.groupBy("source_id").agg(F.count_distinct("page").alias("cited"))
    out = files.join(cited, "source_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    return out.select("source_id", "pages", "cited", (F.col("cited") < F.col("pages") * 0.5).alias("thin"))
