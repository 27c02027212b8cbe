"""Judging retrieval: measures of runs, comparisons with significance, recall of searches, judged pairs from notes."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLIPS = 100_000
#: Numbers that are drawn at once.
DRAWN = 1_000_000


def relevant(hit_path: Column, hit_page: Column, hit_section: Column, judged: Column) -> Column:
    """Whether a hit is in an array of judgements (path, pages, note, section): a note by equality and, if named, its section; else a path contained and, if named, one of the pages."""
    def one(r: Column) -> Column:
        note = (F.coalesce(r.note, F.lit("")) != "") & (r.note == hit_path) & ((F.coalesce(r.section, F.lit("")) == "") | F.array_contains(F.split(F.coalesce(hit_section, F.lit("")), " > "), r.section))
        file = (F.coalesce(r.note, F.lit("")) == "") & F.contains(F.lower(hit_path), F.lower(r.path)) & ((F.coalesce(F.size(r.pages), F.lit(0)) <= 0) | F.array_contains(r.pages, hit_page))
        return F.coalesce(note, F.lit(False)) | F.coalesce(file, F.lit(False))

    return F.exists(judged, one)


def measures(run: DataFrame, found: int = 10) -> DataFrame:
    """(query_id, rr, p5, found) of a run (query_id, pos, rel)."""
    first = F.min(F.when(F.col("rel"), F.col("pos")))
    return run.groupBy("query_id").agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"), (F.count_if(F.col("rel") & (F.col("pos") <= 5)) / 5).alias("p5"), F.coalesce(first <= found, F.lit(False)).alias("found"))


def report(measured: DataFrame, by: list[str]) -> DataFrame:
    """Means by mode and style, and over all styles."""
    return measured.rollup(*by).agg(F.count(F.lit(1)).alias("queries"), F.avg("rr").alias("mrr"), F.avg("p5").alias("p5"), F.avg(F.col("found").cast("int")).alias("found"))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided, ties left out."""
    n, k = wins + losses, max(wins, losses)
    if n == 0:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k, n + 1))
    return min(1.0, 2 * tail)


def randomization_test(differences: list[float], flips: int = FLIPS, seed: int = 1) -> float:
    """``counted_randomization_test`` of a list."""
    return counted_randomization_test(Counter(differences), flips, seed)


def counted_randomization_test(differences: Mapping[float, int], flips: int = FLIPS, seed: int = 1) -> float:
    """Chance of a mean at least as large when signs are drawn anew; all signs are tried for up to 16 differences.

    differences: how often each occurs. Of n differences of one size as many get a plus as a binomial draw says, so
    memory does not grow with n.
    """
    sizes: Counter[float] = Counter()
    for x, n in differences.items():
        sizes[abs(x)] += n
    del sizes[0.0]
    if not sizes:
        return 1.0
    total = math.fsum(x * n for x, n in sizes.items())
    seen = abs(math.fsum(x * n for x, n in differences.items())) - 1e-12 * max(1.0, total)
    if sizes.total() <= 16:
        d = sorted(sizes.elements())
        return sum(abs(sum(s * x for s, x in zip(signs, d, strict=True))) >= seen for signs in itertools.product((1, -1), repeat=len(d))) / 2 ** len(d)
    x, n = np.array(sorted(sizes)), np.array([sizes[x] for x in sorted(sizes)])
    rng, beyond, together = np.random.default_rng(seed), 0, max(1, DRAWN // len(x))
    for at in range(0, flips, together):
        plus = np.zeros(rows := min(together, flips - at))
        for part in range(0, len(x), DRAWN):
            plus += rng.binomial(n[part : part + DRAWN], 0.5, size=(rows, len(x[part : part + DRAWN]))) @ x[part : part + DRAWN]
        beyond += int((np.abs(2 * plus - total) >= seen).sum())
    return (beyond + 1) / (flips + 1)


def compare(a: DataFrame, b: DataFrame) -> dict:
    """Runs (query_id, rr): wins, losses, ties and mean difference of b over a on the queries both have, with two p values."""
    both = a.select("query_id", F.col("rr").alias("x")).join(b.select("query_id", F.col("rr").alias("y")), "query_id")
    rows = both.groupBy((F.col("y") - F.col("x")).alias("d")).count().collect()  # one row a distinct difference, few as ranks are
    d = {r.d: r["count"] for r in rows}
    of = lambda sign: sum(n for x, n in d.items() if x * sign > 0)
    every, wins, losses = sum(d.values()), of(1), of(-1)
    delta = math.fsum(x * n for x, n in d.items()) / every if every else 0.0
    return {"wins": wins, "losses": losses, "ties": every - wins - losses, "delta": delta, "p_sign": sign_test(wins, losses), "p_random": counted_randomization_test(d)}


def outcomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """wins, losses, ties and mean difference as one row."""
    j = a.select("query_id", F.col("rr").alias("x")).join(b.select("query_id", F.col("rr").alias("y")), "query_id")
    return j.agg(F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count_if(F.col("y") < F.col("x")).alias("losses"), F.count_if(F.col("y") == F.col("x")).alias("ties"), F.avg(F.col("y") - F.col("x")).alias("delta"))


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """(query_id, recall) of lists (query_id, ids); 1 where the exact list is empty."""
    j = exact.select("query_id", F.col("ids").alias("e")).join(approx.select("query_id", F.col("ids").alias("a")), "query_id", "left")
    hit = F.size(F.array_intersect("e", F.coalesce("a", F.array().cast(exact.schema["ids"].dataType))))
    return j.select("query_id", F.when(F.size("e") == 0, 1.0).otherwise(hit / F.size("e")).alias("recall"))


def sample(pairs: DataFrame, n: int, by: str = "source") -> DataFrame:
    """The n pairs of each source with the lowest hashes: a sample that stays the same as pairs come and go."""
    key = F.sha2(F.concat_ws("\0", *[F.col(c).cast("string") for c in sorted(pairs.columns)]), 256)
    w = Window.partitionBy(by).orderBy("_k")
    return pairs.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "_k")


def mine_pairs(notes: DataFrame) -> DataFrame:
    """(query, note, section, source): texts that notes use for other notes.

    notes: path, name, aliases, body. An alias asks for its note; the shown text of a link asks for the note it leads to
    (and its section). Names that several notes bear lead nowhere; a text that leads to several notes, or that is the
    name of its note, asks nothing.
    """
    named = notes.groupBy(F.lower("name").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("note"), F.first("name").alias("name")).where("n = 1").select("k", "note", "name")
    alias = notes.select(F.explode("aliases").alias("query"), F.col("path").alias("note"), "name", F.lit("").alias("section"), F.lit("alias").alias("source"))
    links = notes.select(F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("link"))
    target = F.split_part("link", F.lit("|"), F.lit(1))
    shown = F.when(F.contains("link", F.lit("|")), F.split_part("link", F.lit("|"), F.lit(2))).otherwise("")
    parts = links.select(F.lower(F.trim(F.regexp_replace(F.split_part(target, F.lit("#"), F.lit(1)), r"^.*/", ""))).alias("k"), F.trim(F.split_part(target, F.lit("#"), F.lit(2))).alias("section"), F.trim(shown).alias("query"))
    link = parts.where("query <> ''").join(named, "k").select("query", "note", "name", "section", F.when(F.col("section") != "", "section").otherwise("link").alias("source"))
    every = alias.unionByName(link).where((F.trim("query") != "") & (F.lower("query") != F.lower("name"))).distinct()
    lone = every.groupBy(F.lower("query").alias("q")).agg(F.count_distinct("note").alias("n")).where("n = 1").select("q")
    return every.join(lone, F.lower("query") == F.col("q"), "left_semi").select("query", "note", "section", "source")


def word_share(rows: DataFrame, key: str) -> DataFrame:
    """(key, share, style) of rows (key, query, body): the share of the query's distinct words that the body has; all of them make it copied."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    q = rows.select(key, words(F.col("query")).alias("q"), words(F.col("body")).alias("b"))
    share = F.when(F.size("q") == 0, 0.0).otherwise(F.size(F.array_intersect("q", "b")) / F.size("q"))
    return q.select(key, share.alias("share")).withColumn("style", F.when(F.col("share") == 1, "copied").otherwise("rephrased"))
