"""Problem 4: authors of entries and files, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.multivalue import explode_values
from quire.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "citations").select(F.lit("citations").alias("origin"), F.col("citation_id").alias("rec_id"), "authors")
    files = table(spark, d, "source_meta").select(F.lit("source_meta").alias("origin"), F.col("source_id").alias("rec_id"), F.col("author").alias("authors"))
    return explode_values(cited.unionByName(files), ["origin", "rec_id"], "authors")


QUERIES = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
