"""The journal as streams: searches and reads joined as they arrive, late rows within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import journal as J

SEARCH_SCHEMA = "search_id long, at timestamp, origin string, query string, mode string, kind string, hits array<long>, err string"
READ_SCHEMA = "at timestamp, origin string, chunk_id long"


def read_events(searches: DataFrame, reads: DataFrame, late: str = "1 hour") -> DataFrame:
    """(search_id, origin, at, chunk_id, read_at): a stream of hits read within half an hour of their search.

    An interval join: state is kept for the half hour and the watermark only. Searches delivered again within the
    watermark count once.
    """
    s = searches.withWatermark("at", late).dropDuplicatesWithinWatermark(["search_id"]).select("search_id", "origin", "at", F.explode("hits").alias("chunk_id"))
    r = reads.withWatermark("at", late).select(F.col("origin").alias("r_origin"), F.col("chunk_id").alias("r_chunk"), F.col("at").alias("read_at"))
    close = F.expr(f"r_origin = origin AND r_chunk = chunk_id AND read_at >= at AND read_at < at + {J.READ_WITHIN}")
    return s.join(r, close).select("search_id", "origin", "at", "chunk_id", "read_at")


def windowed_usage(searches: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, origin, searches, empty, failed) by event time; a window is final once the watermark has passed it."""
    failed = F.coalesce("err", F.lit("")) != ""
    none = (F.coalesce(F.size("hits"), F.lit(0)) <= 0) & ~failed
    w = searches.withWatermark("at", late).groupBy(F.window("at", window), "origin")
    return w.agg(F.count(F.lit(1)).alias("searches"), F.count_if(none).alias("empty"), F.count_if(failed).alias("failed")).select(F.col("window.start").alias("start"), "origin", "searches", "empty", "failed")


def distinct_searches(searches: DataFrame, late: str = "1 day") -> DataFrame:
    """Without rows delivered again within the watermark."""
    return searches.withWatermark("at", late).dropDuplicatesWithinWatermark(["search_id"])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what has arrived to Parquet and stops; the checkpoint lies in the shared folder."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
