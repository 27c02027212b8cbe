"""Files as DataFrames: walking folders, reading notes, pages and books into chunks, writing bibliographies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import ebooks, markup

# What a walk passes over, and which files belong to which kind.
SKIPPED_FOLDERS = (".git", ".obsidian", ".trash", "node_modules", "99 - templates", "_static", "_sources", "_modules", "_images", "_downloads", ".upload-tmp")
SKIPPED_FILES = ("genindex.html", "search.html", "py-modindex.html")
EXTENSIONS = {"book": ("pdf", "epub", "fb2", "mobi"), "paper": ("pdf",), "vault": ("md",), "docs": ("html",)}
SECTION_LIMITS = {"book": (0, 0), "paper": (0, 0), "vault": (1600, 1000), "docs": (1600, 1000)}
CHUNKS = "kind string, path string, hash string, title string, ord int, heading string, anchor string, tags array<string>, body string, aliases array<string>, error string"


def walk(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(kind, path, hash, content, modified) of a folder's files of a kind; the paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.replace("file://", "").rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^\\Q{base}\\E", "")
    out = files.select(F.lit(kind).alias("kind"), rel.alias("path"), "content", F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(F.element_at(parts, -1))
    ok = F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS[kind]) & ~name.isin(*SKIPPED_FILES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return out.where(ok).withColumn("hash", F.sha2("content", 256))


def extract(kind: str, path: str, data: bytes) -> tuple[str, list[markup.Section], list[str]]:
    """Title, sections and aliases of one file."""
    stem = path.rpartition("/")[2].rpartition(".")[0]
    ext = path.rpartition(".")[2].lower()
    if ext == "md":
        sections, aliases = markup.note_sections(data.decode("utf-8", "replace"))
        return stem, sections, aliases
    if ext == "html":
        text = data.decode("utf-8", "replace")
        manual = path.split("/")[0] if "/" in path else ""
        title = markup.html_title(text, stem)
        return f"{manual} · {title}" if manual else title, markup.html_sections(text), []
    reader = {"epub": ebooks.epub, "fb2": ebooks.fb2, "mobi": ebooks.mobi}.get(ext)
    if reader is None:
        raise ValueError(f"no reader for .{ext}; give its pages as a table")
    sections, meta = reader(data)
    return markup.choose_title(meta["title"], [], stem), sections, []


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["kind", "path", "hash", "title", "ord", "heading", "anchor", "tags", "body", "aliases", "error"]
    for b in batches:
        rows = []
        for kind, path, digest, content in zip(b["kind"], b["path"], b["hash"], b["content"], strict=True):
            try:
                title, sections, aliases = extract(kind, path, bytes(content))
                above, target = SECTION_LIMITS[kind] if not path.lower().endswith((".epub", ".fb2", ".mobi")) else (1600, 1000)
                n = 0
                for s in sections:
                    for part in markup.split_section(s.body, above, target):
                        n += 1
                        rows.append((kind, path, digest, title.replace("\0", ""), n, s.heading.replace("\0", ""), s.anchor, s.tags, part.replace("\0", ""), aliases, None))
            except Exception as e:  # noqa: BLE001  one bad file is told of, never fatal
                rows.append((kind, path, digest, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(rows, columns=columns)


def read_chunks(files: DataFrame) -> DataFrame:
    """Files (kind, path, hash, content) -> chunks with their language; a file that can't be read gives one row with the error."""
    out = files.select("kind", "path", "hash", "content").mapInPandas(_chunks, CHUNKS)
    return out.withColumn("lang", F.when(F.col("body").isNotNull(), T.language(F.col("body"))))


def write_bibliography(records: DataFrame, path: str) -> bool:
    """Writes records, sorted by citekey, as JSON lines; leaves the files alone if nothing changed. Tells whether it wrote."""
    spark = records.sparkSession
    lines = records.select("citekey", F.to_json(F.struct(*sorted(records.columns))).alias("value"))
    sign = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h")).first()
    try:
        if sign(spark.read.text(path)) == sign(lines.select("value")):
            return False
    except Exception:  # noqa: BLE001, S110  nothing there yet
        pass
    lines.orderBy("citekey").select("value").write.mode("overwrite").text(path)
    return True


def read_bibliography(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
