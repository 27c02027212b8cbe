"""Tables of the library as snapshots: every change gives the next snapshot, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.runtime import ranged_neighbours

MAX_ATTEMPTS = 3
NEIGHBOUR_CHARS, BODY_CHARS = 500, 5000


# ---- files ----------------------------------------------------------------------------------------------------------


def unchanged(found: DataFrame, sources: DataFrame, rules: int = 0) -> DataFrame:
    """(kind, path) of files with the bytes, and read under rules at least as new as, the snapshot has."""
    old = sources.select("kind", "path", F.col("hash").alias("_h"), F.col("rules").alias("_r"))
    return found.join(old, ["kind", "path"]).where((F.col("hash") == F.col("_h")) & (F.col("_r") >= rules)).select("kind", "path")


def renamed(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, path): sources whose old path is gone and whose bytes lie under a new one (the first of them)."""
    gone = sources.join(found.select("kind", "path"), ["kind", "path"], "left_anti").select("kind", "hash", "source_id", "path")
    new = found.join(sources.select("kind", "path"), ["kind", "path"], "left_anti").groupBy("kind", "hash").agg(F.min("path").alias("new_path"))
    w = Window.partitionBy("kind", "hash").orderBy("path")
    one = gone.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.join(new, ["kind", "hash"]).select("source_id", F.col("new_path").alias("path"))


def prune(sources: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """Without the sources of a kind that were not found; nothing found means the walk failed, and nothing goes."""
    seen = found.where(F.col("kind") == kind).select("kind", "path")
    if seen.isEmpty():
        return sources
    return sources.where(F.col("kind") != kind).unionByName(sources.where(F.col("kind") == kind).join(seen, ["kind", "path"], "left_semi"))


def replace_sources(sources: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("kind", "path")) -> DataFrame:
    """Rows of new instead of those with the same key."""
    return sources.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(sources.columns))


def orphans_out(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def set_titles(sources: DataFrame, titles: DataFrame) -> DataFrame:
    """New titles where they differ. titles: source_id, new_title."""
    return sources.join(titles, "source_id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title").select(sources.columns)


def rehash(tables: dict[str, tuple[DataFrame, str]], moved: DataFrame) -> dict[str, DataFrame]:
    """Everything filed under an old hash goes under the new one. moved: old, new. A new hash that two old ones share is refused."""
    clean = moved.join(moved.groupBy("new").agg(F.count_distinct("old").alias("k")).where("k = 1"), "new").select("old", "new")
    return {n: df.join(clean, df[c] == clean["old"], "left").withColumn(c, F.coalesce("new", c)).drop("old", "new").select(df.columns) for n, (df, c) in tables.items()}


def merge_newer(old: DataFrame, new: DataFrame, key: str = "key", at: str = "updated_at", unique: str = "citekey") -> DataFrame:
    """Per key the later row, the old one at equal times; a new row whose citekey another key holds is left out."""
    held = old.select(F.col(unique).alias("_u"), F.col(key).alias("_k"))
    ok = new.join(held, (F.col(unique) == F.col("_u")) & (F.col(key) != F.col("_k")), "left_anti")
    both = old.withColumn("_new", F.lit(0)).unionByName(ok.select(old.columns).withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(at, -F.col("_new"))).alias("r"))
    return best.select("r.*")


def listing(sources: DataFrame, counts: DataFrame, scans: DataFrame, kind: str = "", prefix: str = "") -> DataFrame:
    """Indexed sources with their counts, and scans that are not indexed yet; counts are aggregated before the join."""
    own = sources.join(counts, "source_id", "left").select("kind", "path", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"), F.lit(False).alias("scan"))
    waiting = scans.join(sources.select("kind", "path"), ["kind", "path"], "left_anti")
    more = waiting.select("kind", "path", T.scan_title(F.col("path")).alias("title"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("embedded"), F.lit(True).alias("scan"))
    out = own.unionByName(more)
    out = out.where(F.col("kind") == kind) if kind else out
    return out.where(F.startswith(F.col("path"), F.lit(prefix))) if prefix else out


def missing_pages(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(hash, page) that recognition still has to read. files: hash, pages; cached: hash, page."""
    every = files.where("pages > 0").select("hash", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    return every.join(cached.select("hash", "page"), ["hash", "page"], "left_anti")


# ---- embeddings -----------------------------------------------------------------------------------------------------


def embed_windows(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, source_id, ord, window, hash): the text a chunk is embedded as, and its key.

    The last 500 characters before, the first 5000 of the body, the first 500 after; notes begin with title > heading.
    """
    edges = lambda side: side(F.col("body"), F.lit(NEIGHBOUR_CHARS))  # noqa: E731 - of the neighbours only these are moved
    beside = ranged_neighbours(chunks.select("chunk_id", "source_id", "ord", "heading", F.left("body", F.lit(BODY_CHARS)).alias("own"), "body"), "source_id", "ord", edges(F.right), edges(F.left))
    rows = beside.drop("body").join(sources.select("source_id", "kind", "title"), "source_id")
    head = F.when(F.col("kind") == "vault", F.concat_ws(" > ", F.nullif("title", F.lit("")), F.nullif(F.coalesce("heading", F.lit("")), F.lit(""))))
    text = F.concat_ws(" ", head, F.nullif("_before", F.lit("")), "own", F.nullif("_after", F.lit("")))
    return rows.select("chunk_id", "source_id", "ord", text.alias("window")).withColumn("hash", F.sha2("window", 256))


def pending() -> Column:
    """Not embedded and not given up."""
    return F.col("embedding").isNull() & (F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS)


def queue(chunks: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(hash, source_id, ord): what to embed next: of the lowest source with pending texts, each text once, in order."""
    waiting = chunks.select("source_id", "ord", F.col("embed_hash").alias("hash")).join(vectors.select("hash", "embedding", "attempts"), "hash", "left").where(pending())
    first = waiting.agg(F.min("source_id").alias("source_id"))
    return waiting.join(F.broadcast(first), "source_id", "left_semi").groupBy("source_id", "hash").agg(F.min("ord").alias("ord")).orderBy("ord", "hash").limit(limit).select("hash", "source_id", "ord")


def progress(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source_id, chunks, embedded, quarantined)."""
    rows = chunks.select("source_id", F.col("embed_hash").alias("hash")).join(vectors.select("hash", F.col("embedding").isNotNull().alias("done"), "attempts"), "hash", "left")
    given_up = ~F.coalesce("done", F.lit(False)) & (F.coalesce("attempts", F.lit(0)) >= MAX_ATTEMPTS)
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("done", F.lit(False))).alias("embedded"), F.count_if(given_up).alias("quarantined"))


def attempted(vectors: DataFrame, batch: DataFrame, step: int = 1) -> DataFrame:
    """Attempts of a batch of hashes counted up (step 1) or back (-1, never below 0); unknown hashes come in."""
    hit = batch.select("hash").distinct().withColumn("_hit", F.lit(True))
    out = vectors.join(hit, "hash", "full")
    return out.withColumn("attempts", F.when(F.col("_hit"), F.greatest(F.coalesce("attempts", F.lit(0)) + step, F.lit(0))).otherwise(F.col("attempts"))).select(vectors.columns)


def requeue(vectors: DataFrame) -> DataFrame:
    """Texts that were given up get another chance."""
    again = F.col("embedding").isNull() & (F.col("attempts") >= MAX_ATTEMPTS)
    return vectors.withColumn("last_error", F.when(again, None).otherwise(F.col("last_error"))).withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts")))


def prune_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors that some chunk still uses."""
    return vectors.join(chunks.select(F.col("embed_hash").alias("hash")), "hash", "left_semi")


def saved(vectors: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot with a batch (hash, embedding, embedded_at, last_error) written: a vector clears the error, an error keeps the vector null."""
    new = batch.select("hash", F.col("embedding").alias("_e"), F.col("embedded_at").alias("_t"), F.col("last_error").alias("_x"))
    out = vectors.join(new, "hash", "left")
    got = F.col("_e").isNotNull()
    return (
        out.withColumn("embedding", F.coalesce("_e", "embedding")).withColumn("embedded_at", F.when(got, F.col("_t")).otherwise(F.col("embedded_at"))).withColumn("last_error", F.when(got, None).otherwise(F.coalesce("_x", "last_error"))).select(vectors.columns)
    )


# ---- bibliography ---------------------------------------------------------------------------------------------------


def undescribed(sources: DataFrame, chunks: DataFrame, described: DataFrame) -> DataFrame:
    """(source_id, key, head, tail): books and papers without a record, with their first eight and last four bodies."""
    open_ = sources.where(F.col("kind").isin("book", "paper")).withColumn("key", T.reference_key(F.col("kind"), F.col("path"), F.col("hash"))).join(described.select("key"), "key", "left_anti")
    rows = chunks.join(open_.select("source_id"), "source_id", "left_semi")
    up, down = Window.partitionBy("source_id").orderBy("ord"), Window.partitionBy("source_id").orderBy(F.desc("ord"))
    first = rows.select("source_id", "ord", "body").withColumn("_n", F.row_number().over(up)).where("_n <= 8")
    last = rows.select("source_id", "ord", "body").withColumn("_n", F.row_number().over(down)).where("_n <= 4")
    text = lambda df, c: df.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "body"))), lambda x: x.body), "\n").alias(c))
    return open_.select("source_id", "key").join(text(first, "head"), "source_id", "left").join(text(last, "tail"), "source_id", "left")


def citekeys(records: DataFrame) -> DataFrame:
    """(key, citekey): first family name or first telling title word, and year; equal ones get a, b, c... in order of key; a checked record keeps its own.

    records: key, family, title, year, status, citekey.
    """
    words = F.filter(F.split(F.trim("title"), r"\s+"), lambda w: ~F.lower(w).isin("the", "a", "an", "on", "of", "and"))
    name = F.coalesce(F.nullif(F.trim("family"), F.lit("")), F.get(words, F.lit(0)), F.lit(""))
    base = F.concat(T.slug(name), F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("")))
    based = records.withColumn("base", F.when(base == "", "ref").otherwise(base))
    taken = records.where("status = 'checked'").select(F.col("citekey").alias("base"), F.lit(1).alias("_t")).distinct()
    # there are letters for 26 only: the first of each base are ranked, which Spark cuts before the shuffle, the rest share the last letter
    rank = F.row_number().over(Window.partitionBy("base").orderBy("key"))
    first = based.where("status <> 'checked'").select("base", "key").withColumn("n", rank).where("n <= 27").drop("base")
    drafts = based.where("status <> 'checked'").join(first, "key", "left").join(taken, "base", "left").withColumn("n", F.coalesce("n", F.lit(27)) + F.coalesce("_t", F.lit(0)))
    suffix = F.when(F.col("n") == 1, "").otherwise(F.char(F.least(F.col("n") - 2, F.lit(25)) + 97))
    return drafts.select("key", F.concat("base", suffix).alias("citekey")).unionByName(based.where("status = 'checked'").select("key", "citekey"))


# ---- views of the library -------------------------------------------------------------------------------------------


def totals(listed: DataFrame) -> DataFrame:
    return listed.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"), F.sum("embedded").alias("embedded"))


def manuals(sources: DataFrame) -> DataFrame:
    """(site, pages, home, indexed_at): each manual with its best home page: an index page, then the one nearest the root, then by path."""
    pages = sources.where("kind = 'docs'").withColumn("site", F.split_part("path", F.lit("/"), F.lit(1)))
    order = F.struct(~F.col("path").rlike(r"(^|/)index\.html$"), F.size(F.split("path", "/")), "path")
    return pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.min_by("path", order).alias("home"), F.max("indexed_at").alias("indexed_at"))


def state() -> Column:
    """What a listed row shows: waiting, embedding, ready or errors. Needs chunks, embedded, quarantined, scan."""
    done = F.col("embedded") + F.col("quarantined")
    return F.when(F.col("scan"), "recognising").when(F.col("chunks") == 0, "waiting").when(done < F.col("chunks"), "embedding").when(F.col("quarantined") > 0, "errors").otherwise("ready")


# ---- queues ---------------------------------------------------------------------------------------------------------


def next_scans(scans: DataFrame, limit: int) -> DataFrame:
    """Scans with pages left to recognise and attempts left, least tried first."""
    return scans.where((F.col("recognised") < F.col("pages")) & (F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS)).orderBy("attempts", "path", "hash").limit(limit)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.select(old.columns).join(old.select(key), key, "left_anti").select(old.columns))
