"""Lines repeated across one site's documents (problem 5).

The state of a site is kept as tables: how many distinct documents hold each line key, how many documents there are,
which lines recur, the lines of the documents seen, and what was found in them. A new partition of documents is counted
alone (the delta), merged into the state by addition, and the lines whose standing changed are the crossings; only the
new documents and the old ones that hold a crossed line are looked at again.

Line key: the letters of a line, lower-cased. Lines without letters have no key and never count.
Nulls: documents with a null id, site or body take no part in counts and come out unchanged. An empty table gives
an empty result. A document delivered twice counts once, in one partition or in several; what came first holds. Extra
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialise, maybe_broadcast

MIN_DOCS = 5
MIN_PERCENT = 15


def keyed_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, site, body) -> one row per distinct doc_id: site and ``lines``, an array of (line_no, key).

    The key is a 96-bit hash, so no text is shuffled. Bodies are read once and dropped here.
    """
    line = F.transform(
        F.split(F.col("body"), "\n", -1),
        lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), F.regexp_replace(F.lower(x), r"[^\p{L}]+", "").alias("letters")),
    )
    lettered = F.filter(line, lambda x: x.letters != "")
    keyed = F.transform(lettered, lambda x: F.struct(x.line_no.alias("line_no"), F.struct(F.xxhash64(x.letters).alias("a"), F.hash(x.letters).alias("b")).alias("key")))
    return (
        docs.where(F.col("doc_id").isNotNull() & F.col("site").isNotNull() & F.col("body").isNotNull())
        .select("doc_id", "site", keyed.alias("lines"), *keep)
        .dropDuplicates(["doc_id"])
    )


def count_delta(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line counts (site, key, docs) and site sizes (site, total) of one partition of distinct documents.

    Keys are made distinct within a document before the explode, so the only shuffle is of partial sums.
    """
    counts = lines.select("site", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("docs"))
    return counts, lines.groupBy("site").agg(F.count(F.lit(1)).alias("total"))


def merge_counts(state: tuple[DataFrame, DataFrame] | None, delta: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Add a delta to the state; documents of the delta must be new (``update`` sees to it)."""
    if state is None:
        return delta
    counts = state[0].unionByName(delta[0]).groupBy("site", "key").agg(F.sum("docs").alias("docs"))
    return counts, state[1].unionByName(delta[1]).groupBy("site").agg(F.sum("total").alias("total"))


def recurring(state: tuple[DataFrame, DataFrame], min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(site, key) of the lines in at least ``min_docs`` and ``min_percent`` per cent of the site's documents."""
    counts, sizes = state
    often = counts.where(F.col("docs") >= min_docs)
    return often.join(maybe_broadcast(sizes), "site").where(F.col("docs") * 100 >= F.col("total") * min_percent).select("site", "key")


def crossings(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(site, key, recurs): lines that began to recur, or ceased to as the site grew."""
    if before is None:
        return after.withColumn("recurs", F.lit(True))
    began = after.join(before, ["site", "key"], "left_anti").withColumn("recurs", F.lit(True))
    return began.unionByName(before.join(after, ["site", "key"], "left_anti").withColumn("recurs", F.lit(False)))


def repeated_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, line_no) of every line whose (site, key) recurs."""
    each = lines.select("doc_id", "site", F.explode("lines").alias("l")).select("doc_id", "site", "l.line_no", F.col("l.key").alias("key"))
    return each.join(maybe_broadcast(repeated.select("site", "key")), ["site", "key"]).select("doc_id", "line_no")


def touched(lines: DataFrame, crossed: DataFrame) -> DataFrame:
    """doc_id of the documents that hold a crossed line, the only ones to rebuild."""
    each = lines.select("doc_id", "site", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key"))
    return each.join(maybe_broadcast(crossed.select("site", "key")), ["site", "key"], "left_semi").select("doc_id").distinct()


def rebuild(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, body) without the found lines, for documents that have any; the others need no rebuild."""
    drop = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.array_join(
        F.transform(
            F.filter(F.transform(F.split("body", "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("t"))), lambda s: ~F.array_contains("_drop", s.n)),
            lambda s: s.t,
        ),
        "\n",
    )
    return docs.select("doc_id", "body").dropDuplicates(["doc_id"]).join(drop, "doc_id").select("doc_id", kept.alias("body"))


def site_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of manuals as (doc_id, site, body, source_id); the site is the first part of the path."""
    sites = sources.where(F.col("kind") == "docs").select("source_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("site"))
    return chunks.select("source_id", F.col("chunk_id").alias("doc_id"), "body").join(maybe_broadcast(sites), "source_id").select("doc_id", "site", "body", "source_id")


class State(NamedTuple):
    """The stored tables of all sites after a partition."""

    counts: DataFrame  # (site, key, docs)
    sizes: DataFrame  # (site, total)
    repeated: DataFrame  # (site, key): the lines that recur
    lines: DataFrame  # (doc_id, site, lines) of all documents seen; a table for every partition
    found: DataFrame  # (doc_id, line_no): the recurring lines of all documents seen


class Step(NamedTuple):
    state: State
    crossed: DataFrame  # (site, key, recurs)
    rebuild: DataFrame  # (doc_id): documents whose text without recurring lines is new or another than before


def update(state: State | None, new_lines: DataFrame) -> Step:
    """Fold a partition in: merge its counts, detect crossings, and find lines anew in the documents they touch."""
    new = new_lines.select("doc_id", "site", "lines")
    if state is not None:
        new = new.join(state.lines.select("doc_id"), "doc_id", "left_anti")
    new = materialise(new, "lines")
    counts, sizes = merge_counts((state.counts, state.sizes) if state is not None else None, count_delta(new))
    counts, sizes = materialise(counts, "counts"), materialise(sizes, "sizes")
    repeated = materialise(recurring((counts, sizes)), "repeated")
    crossed = materialise(crossings(state.repeated if state is not None else None, repeated), "crossed")
    if state is None:
        found = materialise(repeated_lines(new, repeated), "found")
        return Step(State(counts, sizes, repeated, new, found), crossed, found.select("doc_id").distinct())
    again = materialise(touched(state.lines, crossed), "touched")
    anew = state.lines.join(again, "doc_id", "left_semi").unionByName(new)
    fresh = materialise(repeated_lines(anew, repeated), "fresh")
    found = materialise(state.found.join(again, "doc_id", "left_anti").unionByName(fresh), "found")
    rebuilt = again.unionByName(fresh.select("doc_id")).distinct()
    return Step(State(counts, sizes, repeated, state.lines.unionByName(new), found), crossed, rebuilt)


def fold(partitions: Iterable[DataFrame]) -> Iterator[Step]:
    """Partitions of ``keyed_lines`` one after another, as they arrive."""
    state = None
    for part in partitions:
        step = update(state, part)
        state = step.state
        yield step


def rebuilt_bodies(docs: DataFrame, steps: list[Step]) -> DataFrame:
    """(doc_id, body) of all documents with recurring lines; each as the last step that touched it built it."""
    bodies = None
    for step in steps:
        built = rebuild(docs.join(step.rebuild, "doc_id", "left_semi"), step.state.found)
        bodies = built if bodies is None else bodies.join(step.rebuild, "doc_id", "left_anti").unionByName(built)
    return bodies
