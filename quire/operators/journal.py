"""The journal of searches and reads, and the indexer's heartbeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETENTION = "INTERVAL 180 DAYS"
READ_WITHIN = "INTERVAL 30 MINUTES"
BEAT_SILENCE = 90


def retained(log: DataFrame, now: F.Column, at: str = "at") -> DataFrame:
    """Rows that are not older than the retention."""
    return log.where(F.col(at) >= now - F.expr(RETENTION))


def read_searches(searches: DataFrame, reads: DataFrame) -> DataFrame:
    """search_id of searches with a hit that was read, from the same origin, within half an hour of the search.

    Hits are exploded to an equi-join on (origin, chunk) with a time range; a hit read by many searches is a skewed key
    that adaptive execution splits.
    """
    hits = searches.select("search_id", "origin", "at", F.explode("hits").alias("chunk_id"))
    r = reads.select("origin", "chunk_id", F.col("at").alias("read_at"))
    close = (F.col("read_at") >= F.col("at")) & (F.col("read_at") < F.col("at") + F.expr(READ_WITHIN))
    return hits.join(r, ["origin", "chunk_id"]).where(close).select("search_id").distinct()


def usage(searches: DataFrame, reads: DataFrame, since: F.Column | None = None) -> DataFrame:
    """(origin, searches, empty, failed, read) of a time window."""
    s = searches if since is None else searches.where(F.col("at") >= since)
    marked = s.join(read_searches(s, reads).withColumn("_r", F.lit(True)), "search_id", "left")
    failed = F.coalesce("err", F.lit("")) != ""
    return marked.groupBy("origin").agg(
        F.count(F.lit(1)).alias("searches"),
        F.count_if((F.coalesce(F.size("hits"), F.lit(0)) <= 0) & ~failed).alias("empty"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.coalesce("_r", F.lit(False))).alias("read"),
    )


def listed(searches: DataFrame, limit: int = 50, origin: str = "", empty_only: bool = False) -> DataFrame:
    """The newest searches; a limit out of 1..500 becomes 50."""
    n = limit if 1 <= limit <= 500 else 50
    out = searches.where(F.col("origin") == origin) if origin else searches
    out = out.where((F.coalesce(F.size("hits"), F.lit(0)) <= 0) & (F.coalesce("err", F.lit("")) == "")) if empty_only else out
    return out.orderBy(F.desc("at"), F.desc("search_id")).limit(n)


def pulse(beats: DataFrame, now: F.Column) -> DataFrame:
    """The last beat, its silence in seconds, and whether the indexer is alive."""
    last = beats.agg(F.max_by(F.struct(*beats.columns), "at").alias("b")).select("b.*")
    silence = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    return last.withColumn("silence", silence).withColumn("alive", F.col("silence") < BEAT_SILENCE)


def daily(searches: DataFrame) -> DataFrame:
    """(day, origin, searches, words, hits): how much is asked and found a day."""
    return searches.groupBy(F.to_date("at").alias("day"), "origin").agg(
        F.count(F.lit(1)).alias("searches"), F.sum(F.size(F.split(F.trim(F.coalesce("query", F.lit(""))), r"\s+"))).alias("words"), F.sum(F.greatest(F.coalesce(F.size("hits"), F.lit(0)), F.lit(0))).alias("hits")
    )
