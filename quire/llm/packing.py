"""Filling fixed-capacity containers with items (problem 8).

Only the counts of items by length matter for a good filling, and there are at most ``capacity`` lengths, so the plan
is made on the driver from that bounded table, whatever the number of items. Exact-complement hashing: for the gap
that a container has left, look for one available length that fills it exactly, then a pair, then a triple (by a table
of the sums of two available lengths; a sum that fails is struck out, so each fails once); if there is none, put in the longest length that fits (best fit) and look again for the
smaller gap. A pattern is used as often as the counts allow, so every step uses up a length.

Items get ranks within their length and are joined with the slots of the patterns on (length, rank), a key without
skew. A hot length is ranked in salted parts.

An item longer than the capacity is divided into full containers and a rest, which is packed as an item. Null and
empty texts (0 tokens) need no room and come out in no container. A repeated doc_id counts once. Capacities that are
null or below 1 are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import salted_row_number

Pattern = tuple[list[int], int]  # lengths in one container, number of such containers

#: Containers that are made from one row, so that no task makes too many slots.
SLOT_CHUNK = 5_000


class Index:
    """Availability by length, with exact complements of one, two and three lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] += n
        here = (self.left > 0).astype(np.float64)
        size = 1 << (2 * len(here)).bit_length()
        f = np.fft.rfft(here, size)
        #: whether two available lengths may have a sum; lengths are only used up, so what is false stays so
        self.pairs = np.fft.irfft(f * f, size)[: len(here)] > 0.5

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair with the longest member that fills the gap."""
        if gap < 2 or not self.pairs[gap]:
            return None
        low = self.left[1 : gap // 2 + 1]
        high = self.left[gap - 1 : gap - gap // 2 - 1 : -1]
        ok = (low > 0) & (high > 0)
        if gap % 2 == 0 and len(ok) and self.left[gap // 2] < 2:
            ok[-1] = False
        i = int(np.argmax(ok)) if len(ok) else 0
        return [gap - i - 1, i + 1] if len(ok) and ok[i] else None

    def triple(self, gap: int) -> list[int] | None:
        """A triple that fills the gap, with the longest first length that has a pair beside it."""
        if gap < 3:
            return None
        firsts = np.flatnonzero((self.left[1 : gap - 1] > 0) & self.pairs[gap - 1 : 1 : -1]) + 1
        for a in firsts[::-1].tolist():
            self.left[a] -= 1
            found = self.pair(gap - a)
            self.left[a] += 1
            if found:
                return [a, *found]
            if not self.pair(gap - a):
                self.pairs[gap - a] = False
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def longest(self, most: int) -> int:
        here = np.flatnonzero(self.left[: most + 1])
        return int(here[-1]) if len(here) else 0


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up exactly the given counts; no pattern is longer than the capacity."""
    index = Index(counts, capacity)
    out: list[Pattern] = []
    while first := index.longest(capacity):
        taken = [first]
        index.left[first] -= 1
        gap = capacity - first
        while gap:
            if found := index.exact(gap):
                taken += found
                for x in found:
                    index.left[x] -= 1
                break
            more = index.longest(gap)
            if not more:
                break
            taken.append(more)
            index.left[more] -= 1
            gap -= more
        uses = {x: taken.count(x) for x in taken}
        again = min(int(index.left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            index.left[x] -= n * again
        out.append((taken, again + 1))
    return out


def parts(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, start, length): items within the capacity; longer ones in full parts and a rest."""
    cut = F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))
    each = sizes.where("n_tokens > 0").dropDuplicates(["doc_id"]).select("doc_id", "n_tokens", F.posexplode(cut).alias("k", "_"))
    start = F.col("k").cast("long") * capacity
    return each.select("doc_id", (F.col("k") + 1).alias("part"), start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).cast("int").alias("length"))


def _slots(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """(length, rank, container): one row per place in a container, made by the executors from the patterns alone."""
    rows, used, container = [], {}, 0
    for taken, times in patterns:
        uses = sorted({x: taken.count(x) for x in taken}.items())
        rows.append((container, times, [(x, k, used.get(x, 0)) for x, k in uses]))
        for x, k in uses:
            used[x] = used.get(x, 0) + times * k
        container += times
    df = spark.createDataFrame(rows, "base long, times long, uses array<struct<length:int,k:int,rank:long>>")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SLOT_CHUNK))).alias("chunk")
    chunks = df.select("base", "times", "uses", chunk).repartition(spark.sparkContext.defaultParallelism * 4)
    first = F.col("chunk") * SLOT_CHUNK
    one = chunks.select("base", "uses", F.explode(F.sequence(first, F.least(first + SLOT_CHUNK, F.col("times")) - 1)).alias("c")).select("base", "c", F.explode("uses").alias("u"))
    place = one.select("base", "c", "u", F.explode(F.sequence(F.lit(1), F.col("u.k"))).alias("i"))
    return place.select(F.col("u.length").alias("length"), (F.col("u.rank") + F.col("c") * F.col("u.k") + F.col("i")).alias("rank"), (F.col("base") + F.col("c") + 1).alias("container"))


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, n_tokens) -> (container, doc_id, part, start, length)."""
    spark = sizes.sparkSession
    items = parts(sizes, capacity)
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return items.select(F.lit(0).cast("long").alias("container"), "doc_id", "part", "start", "length").where("false")
    ranked = salted_row_number(items, ["length"], ["doc_id", "part"], "rank")
    # the size of exploded slots is underestimated; without the hint they would be broadcast
    return ranked.join(_slots(spark, plan(counts, capacity)).hint("merge"), ["length", "rank"]).select("container", "doc_id", "part", "start", "length")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens and the share of room that is used."""
    one = packed.agg(F.count_distinct("container").alias("containers"), F.sum("length").alias("tokens"))
    return one.select("containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))
