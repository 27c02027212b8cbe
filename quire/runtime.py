"""Session-level helpers: shared work folder, size-checked broadcast, skew-safe ranking."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it has at most this many rows and bytes.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32 << 20
#: Whether the shuffle files of a query are deleted at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, a single machine) a temporary folder is set once for the session.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _work(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back; ``clean_up`` deletes it.

    What was shuffled for the table is deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{_work(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def together(tables: list[DataFrame]) -> DataFrame:
    """Materialised tables of one schema as one scan: small files of all of them share tasks."""
    spark, at = tables[0].sparkSession, {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}
    return spark.read.schema(tables[0].schema).parquet(*sorted(at)) if at else tables[0]


def discard(df: DataFrame, name: str = "") -> None:
    """Delete the materialised tables (of a name, or all) that ``df`` reads; nothing may read them any more."""
    spark = df.sparkSession
    work = re.sub("^file:/+", "/", _work(spark))
    for at in {re.sub("^file:/+", "/", f).rpartition("/")[0] for f in df.inputFiles()}:
        if at.startswith(f"{work}/{name}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{_work(spark)}/{at.rpartition('/')[2]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete the tables that this application has materialised, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_work(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    total = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if ``df`` is small enough, else leave the join to a shuffle (AQE splits its skew).

    The check stops at the bound of rows, so it is cheap for any size.
    """
    got = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("bytes")).first()
    return F.broadcast(df) if got.rows <= max_rows and (got.bytes or 0) <= max_bytes else df


def salted_row_number(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", salts: int | None = None) -> DataFrame:
    """Number the rows of each key from 1 without putting a hot key into one task.

    Rows of a key are spread over ``salts`` (as many as shuffle partitions, 64 at least) by a hash of ``order``; the number of a row is its number within
    (key, salt) plus the rows of the lower salts. The order within a key is thus by (salt, order): arbitrary but
    reproducible. ``order`` must identify a row.
    """
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    salted = df.withColumn("_salt", salt)
    sizes = salted.groupBy(*keys, "_salt").count()
    below = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_below", F.coalesce(F.sum("count").over(below), F.lit(0))).drop("count")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_n", F.row_number().over(inner))
    # the window's partitions serve the join; offsets may be as many as keys times salts
    joined = numbered.join(offsets.hint("merge"), [*keys, "_salt"]) if keys else numbered.join(F.broadcast(offsets), "_salt")
    return joined.withColumn(out, (F.col("_n") + F.col("_below")).cast("long")).drop("_n", "_below", "_salt")


#: Values of an order that go into one range, so that no task holds all rows of a hot key.
ORDER_RANGE = 1000


def _ranged(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order) / ORDER_RANGE).cast("long"))


def ranged_row_number(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Number the rows of each key from 1 in order, range by range of the order; ties in order get numbers in any order."""
    rows = _ranged(df, order)
    below = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(key, "_range").count().select(key, "_range", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_below"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    return numbered.join(offsets.hint("merge"), [key, "_range"]).withColumn(out, (F.col("_n") + F.col("_below")).cast("int")).drop("_n", "_below", "_range")


def ranged_neighbours(df: DataFrame, key: str, order: str, before: Column, after: Column) -> DataFrame:
    """Adds ``_before`` and ``_after``: ``before`` of the row ahead of each in its key, and ``after`` of the one behind it.

    Windows run within ranges of the order; the rows at the ends of ranges meet in a small table. Keys must not be null.
    """
    rows = _ranged(df, order).withColumn("_b", before).withColumn("_a", after)
    ends = rows.groupBy(key, "_range").agg(F.max_by(F.struct("_b"), order).alias("last"), F.min_by(F.struct("_a"), order).alias("first"))
    across = Window.partitionBy(key).orderBy("_range")
    ends = ends.select(key, "_range", F.lag("last").over(across).alias("_last"), F.lead("first").over(across).alias("_first"))
    w = Window.partitionBy(key, "_range").orderBy(order)
    inside = rows.withColumn("_p", F.lag(F.struct("_b")).over(w)).withColumn("_q", F.lead(F.struct("_a")).over(w))
    joined = inside.join(ends.hint("merge"), [key, "_range"])
    got = joined.withColumn("_before", F.coalesce("_p", "_last")["_b"]).withColumn("_after", F.coalesce("_q", "_first")["_a"])
    return got.drop("_range", "_b", "_a", "_p", "_q", "_last", "_first")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores (a small file) in as many as cores; any larger one as it is.

    For maps that cost far more than moving their input. A large input is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
