"""The citation graph: resolving entries of reference lists to files, and queries over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.runtime import maybe_broadcast

HEAD_CHARS = 600
MIN_TITLE_WORDS = 4
# Order of preference of the ways an entry is matched.
WAYS = {"doi": 1, "isbn": 2, "title": 3, "page": 4}


def first_pages(chunks: DataFrame) -> DataFrame:
    """(source_id, head): the first 600 characters of the normalised text of a file's first page."""
    paged = chunks.where("page IS NOT NULL").select("source_id", "page", "ord", "body")
    first = paged.groupBy("source_id").agg(F.min("page").alias("page"))
    text = paged.join(first, ["source_id", "page"]).groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "body"))), lambda x: x.body), " ").alias("t"))
    return text.select("source_id", F.substring(T.normalize_title(F.col("t")), 1, HEAD_CHARS).alias("head"))


def best_sources(sources: DataFrame) -> DataFrame:
    """One source per file hash: papers before books, then by path, then by id."""
    w = Window.partitionBy("hash").orderBy(F.col("kind") != "paper", "path", "source_id")
    return sources.where(F.col("kind").isin("book", "paper")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _windows(c: F.Column) -> F.Column:
    """All pairs of neighbouring words of a normalised text."""
    words = F.split(c, " ")
    return F.when(F.size(words) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i + 1, 2), " ")))).otherwise(F.array().cast("array<string>"))


def resolve(citations: DataFrame, described: DataFrame, heads: DataFrame, sources: DataFrame, keep: bool = True) -> DataFrame:
    """(paper, list, ord, resolved, matched_by): each entry's best file.

    citations: paper, list, ord, doi, isbn, title, year and, for monotone resolution, resolved and matched_by so far.
    described: key (file hash), kind, doi, isbn, title, year. heads: hash, kind, path, head.

    Four equi-joins: by DOI; by ISBN, to books, where a ten-digit number may lie within a longer one; by title and
    year; and by a title of four and more words found in the first page, blocked on the rarest of its inner pairs of words,
    which stand whole in the page wherever the title begins and ends. A file never cites itself. With ``keep`` an entry that stops matching keeps what it had.
    """
    own = citations.select("paper", "list", "ord", F.lower("doi").alias("doi"), "isbn", "year", T.normalize_title(F.col("title")).alias("t")).dropDuplicates(["paper", "list", "ord"])
    d = described.select("key", "kind", F.lower("doi").alias("ddoi"), F.regexp_replace("isbn", "[^0-9Xx]", "").alias("disbn"), T.normalize_title(F.col("title")).alias("dt"), F.col("year").alias("dy"))
    base = ["paper", "list", "ord"]
    by_doi = own.where("doi <> ''").join(d.where("ddoi <> ''"), F.col("doi") == F.col("ddoi")).select(*base, "key", F.lit("doi").alias("way"))
    parts = d.where("kind = 'book' AND disbn <> ''").select(
        "key", F.explode(F.array_distinct(F.flatten(F.transform(F.array(F.lit(10), F.lit(13)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("disbn") - n + 1, F.lit(1))), lambda i: F.substring("disbn", i, n)))))).alias("part")
    )
    by_isbn = own.where("isbn <> ''").join(parts, F.col("isbn") == F.col("part")).select(*base, "key", F.lit("isbn").alias("way"))
    by_title = own.where("t <> '' AND year IS NOT NULL").join(d.where("dt <> ''"), (F.col("t") == F.col("dt")) & (F.col("year") == F.col("dy"))).select(*base, "key", F.lit("title").alias("way"))
    words = F.split("t", " ")
    titled = own.where(F.size(words) >= MIN_TITLE_WORDS)
    grams = heads.select(F.col("hash").alias("key"), F.explode(_windows(F.col("head"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    inner = titled.select("t", F.explode(_windows(F.array_join(F.slice(words, F.lit(2), F.size(words) - 2), " "))).alias("gram")).distinct()
    rarest = inner.join(often, "gram", "left").groupBy("t").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = titled.join(rarest, "t").join(grams, "gram").join(heads.select(F.col("hash").alias("key"), "head"), "key")
    by_page = met.where(F.contains("head", F.col("t"))).select(*base, "key", F.lit("page").alias("way"))
    shelf = best_sources(sources).select(F.col("hash").alias("key"), F.col("kind").alias("k"), "path")
    cand = by_doi.unionByName(by_isbn).unionByName(by_title).unionByName(by_page).where("key <> paper").distinct()
    ranked = cand.join(maybe_broadcast(shelf), "key", "left").withColumn("rank", F.element_at(F.create_map(*[F.lit(x) for kv in WAYS.items() for x in kv]), F.col("way")))
    w = Window.partitionBy(*base).orderBy("rank", F.coalesce(F.col("k") != "paper", F.lit(True)), "path", "key")
    picked = ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*base, "key", "way")
    old = citations.dropDuplicates(base)
    out = old.join(picked, base, "left")
    if keep and {"resolved", "matched_by"} <= set(citations.columns):
        return out.select(*base, F.coalesce("key", "resolved").alias("resolved"), F.coalesce("way", "matched_by").alias("matched_by"))
    return out.select(*base, F.col("key").alias("resolved"), F.col("way").alias("matched_by"))


def citations_of(citations: DataFrame, resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries with the file each was resolved to, references before other lists, in printed order."""
    shelf = best_sources(sources).select(F.col("hash").alias("resolved"), F.col("kind").alias("source_kind"), F.col("path").alias("source_path"), F.col("title").alias("source_title"))
    return citations.join(resolved, ["paper", "list", "ord"], "left").join(shelf, "resolved", "left")


def citing(edges: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(by, paper, path, entries): the papers that cite each work, each once, under its first path."""
    shelf = best_sources(sources).select(F.col("hash").alias("paper"), "path")
    return edges.where(F.col(by).isNotNull()).groupBy(by, "paper").agg(F.count(F.lit(1)).alias("entries")).join(shelf, "paper", "left")


def shared(a: DataFrame, b: DataFrame, by: str = "fingerprint") -> DataFrame:
    """Entries of a whose work b cites too."""
    return a.join(b.select(by), by, "left_semi")


def coupling(edges: DataFrame, least: int = 2) -> DataFrame:
    """(fingerprint, papers): works cited by at least so many papers."""
    return edges.select("fingerprint", "paper").distinct().groupBy("fingerprint").agg(F.count(F.lit(1)).alias("papers")).where(F.col("papers") >= least)


def unparsed(sources: DataFrame, parsed: DataFrame, version: int) -> DataFrame:
    """(hash, path): papers whose reference list was not read by this version of the parser, one row per file."""
    w = Window.partitionBy("hash").orderBy("path")
    papers = sources.where("kind = 'paper'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("hash", "path")
    return papers.join(parsed.where(F.col("parser") >= version).select(F.col("paper").alias("hash")), "hash", "left_anti")


def replace_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after papers were read again: all their old entries go; '' and 0 become null."""
    clean = new.select(*[F.nullif(F.col(c), F.lit("")) .alias(c) if t == "string" else F.nullif(F.col(c), F.lit(0)).alias(c) if c == "year" else F.col(c) for c, t in new.dtypes])
    return old.join(new.select("paper").distinct(), "paper", "left_anti").unionByName(clean.select(old.columns))


def enrich(entries: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Fills title, authors, container and year where they are missing, by DOI, from a table looked up elsewhere."""
    fields = ("title", "authors", "container", "year")
    found = looked_up.select(F.lower("doi").alias("_doi"), *(F.col(c).alias(f"_{c}") for c in fields)).dropDuplicates(["_doi"])
    got = entries.join(found, F.lower("doi") == F.col("_doi"), "left")
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("" if c != "year" else 0)), F.col(f"_{c}")) for c in fields}
    return got.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in entries.columns])


def note_citations(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """(note, cited, title): ``*Title*, с. N`` in notes, with the first library title that starts so and ends there on a word.

    notes: note, text. titles: place, title. Blocked on the first five characters, which a cited title has at least.
    """
    marks = notes.select("note", F.xxhash64("text").alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\*([^*\n]{5,}?)\*,? с\. ?\d+"), F.lit(1))).alias("at", "cited"))
    key = lambda c: F.lower(F.substring(c, 1, 5))
    lib = titles.select("place", "title", key(F.col("title")).alias("k"))
    rest = F.substring(F.col("title"), F.length("cited") + 1, F.lit(1))
    pairs = marks.withColumn("k", key(F.col("cited"))).join(lib, "k").where(F.lower("title").startswith(F.lower("cited")) & ~rest.rlike(r"[\p{L}\p{Nd}]"))
    first = pairs.groupBy("note", "line", "at").agg(F.min_by("title", F.struct("place", "title")).alias("title"))
    return marks.join(first, ["note", "line", "at"], "left").select("note", "at", "cited", "title")


def tally(found: DataFrame) -> DataFrame:
    """citations, library, sources, notes of a set of note citations."""
    return found.agg(F.count(F.lit(1)).alias("citations"), F.count("title").alias("library"), F.count_distinct("title").alias("sources"), F.count_distinct(F.when(F.col("title").isNotNull(), F.col("note"))).alias("notes"))


def weekly(tallies: DataFrame) -> DataFrame:
    """Change of the library count from week to week; one row a week, so the window is short."""
    return tallies.withColumn("delta", F.col("library") - F.lag("library", 1, 0).over(Window.orderBy("week")))
