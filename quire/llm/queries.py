"""The pN_ queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import boilerplate, lookalikes, matching, mixing, neighbours, packing, ppm, scans, splitting, tokens
from quire.runtime import materialise, spread, table


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Files and entries with the confidence that the entry names the file's work; an entry never its own file."""
    files = table(spark, d, "sources").where(F.col("kind").isin("book", "paper"))
    meta = table(spark, d, "source_meta").select("source_id", "author", "issued")
    first = files.select("source_id", "title").join(meta, "source_id", "left").select(F.col("source_id").alias("id"), "title", F.col("author").alias("persons"), "issued")
    cited = table(spark, d, "citations").select("citation_id", "paper", "title", "authors", "year", "container", "raw").distinct()
    # an entry whose title was not taken from the printed line
    printed = matching.printed_title(F.col("raw"), F.col("authors"), F.col("container"))
    second = cited.select(F.col("citation_id").alias("id"), F.coalesce("title", printed).alias("title"), F.col("authors").alias("persons"), F.col("year").cast("string").alias("issued"))
    found = matching.match(first, second).withColumnRenamed("id", "source_id").withColumnRenamed("id2", "citation_id")
    own = files.select("source_id", "hash").join(cited.select("citation_id", F.col("paper").alias("hash")).distinct(), "hash").select("source_id", "citation_id")
    return found.join(own, ["source_id", "citation_id"], "left_anti")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("source_id", "citation_id")


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("source_id", "citation_id", F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources")
    return scans.damage(scans.pages(spread(table(spark, d, "chunks")), sources), sources).withColumnRenamed("item_id", "chunk_id")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources")
    return scans.clean(scans.pages(spread(table(spark, d, "chunks")), sources), sources).withColumnRenamed("item_id", "chunk_id")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    chunks = spread(table(spark, d, "chunks")).select(F.col("chunk_id").alias("item_id"), "lang", "body")
    docs = table(spark, d, "documents").select("lang", F.col("text").alias("body"))
    return ppm.identify(chunks, ppm.train(ppm.training_rows([chunks, docs])))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ppm.mislabelled(materialise(_languages(spark, d), "segments")).select(F.col("item_id").alias("chunk_id"), "seg", "lang")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select(F.col("item_id").alias("chunk_id"), "seg", "lang", "confidence", "start", "stop")


#: Partitions in which the queries of problem 5 let the manuals arrive, a file with all of its pages at once.
ARRIVALS = 3


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, list[boilerplate.Step]]:
    docs = boilerplate.site_chunks(table(spark, d, "chunks"), table(spark, d, "sources"))
    part = F.pmod(F.xxhash64("source_id"), F.lit(ARRIVALS)).cast("int")
    lines = materialise(boilerplate.keyed_lines(docs.withColumn("part", part), "part"), "arrivals")
    return docs, list(boilerplate.fold(lines.where(F.col("part") == k) for k in range(ARRIVALS)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, steps = _arrivals(spark, d)
    return steps[-1].state.found.select(F.col("doc_id").alias("chunk_id"), "line_no")


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.rebuilt_bodies(*_arrivals(spark, d)).withColumnRenamed("doc_id", "chunk_id")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = table(spark, d, "chunk_vectors").select("vec_id", "embedding")
    pts = materialise(neighbours.points(vectors), "points")
    return vectors, pts, neighbours.graph(pts)


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors, pts, near = _graph(spark, d)
    return neighbours.nearest(pts, neighbours.scored(pts, near), neighbours.members(vectors))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    vectors, pts, near = _graph(spark, d)
    best = neighbours.nearest(pts, neighbours.scored(pts, near, 0.9), neighbours.members(vectors)).where("similarity >= 0.9")
    return best.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


def p6_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50, copies too, against all."""
    vectors, pts, near = _graph(spark, d)
    asked = neighbours.members(vectors).where("vec_id % 50 = 0")
    found = neighbours.search(pts, near, pts.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "e"))
    return asked.join(found.withColumnRenamed("id", "point"), asked["id"] == found["query_id"]).select(F.col("vec_id").alias("query_id"), "rank", F.col("point").alias("id"), "similarity")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return splitting.chunk_items(table(spark, d, "chunks"), table(spark, d, "sources"), table(spark, d, "split_limits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    long = _items(spark, d).where((F.col("above") > 0) & (F.length("text") > F.col("above")))
    return splitting.oversized_pieces(long).where("piece = 2").select(F.col("item_id").alias("chunk_id")).distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_items(spark, d)).withColumnRenamed("item_id", "chunk_id")


def p7_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of every text: how far its pieces reach without a gap, whether all are within the limit and whether overlaps are as given."""
    pieces = splitting.split_items(_items(spark, d))
    limits = _items(spark, d).select("item_id", "above", "overlap").distinct()
    before = Window.partitionBy("item_id").orderBy("piece")
    step = pieces.withColumn("_stop", F.lag("stop").over(before)).join(limits, "item_id")
    over = F.when(F.col("overlap") >= F.col("above"), F.floor(F.col("above") / 2)).otherwise(F.col("overlap"))
    fits = (F.col("above") <= 0) | (F.length("text") <= F.col("above"))
    joined = F.col("_stop").isNull() | (F.col("start") == F.greatest(F.lit(0), F.col("_stop") - over))
    whole = F.length("text") == F.col("stop") - F.col("start")
    return step.groupBy(F.col("item_id").alias("chunk_id")).agg(F.max("stop").cast("long").alias("n_chars"), F.bool_and(fits).alias("fits"), F.bool_and(joined).alias("overlaps"), F.bool_and(whole).alias("whole"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.alike_pairs(materialise(lookalikes.looks(spread(table(spark, d, "documents"))), "looks"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_texts(spread(table(spark, d, "documents")))


def _packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sizes = materialise(tokens.token_counts(spread(table(spark, d, "documents"))), "tokens")
    limits = table(spark, d, "pack_limits").where("capacity_tokens > 0").distinct().orderBy("limit_name").collect()
    return [(r.limit_name, r.capacity_tokens, packing.pack(sizes, r.capacity_tokens).select(F.lit(r.limit_name).alias("limit_name"), "*")) for r in limits]


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [x for _, _, x in _packed(spark, d)])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [packing.fill(x, c).select(F.lit(n).alias("limit_name"), F.lit(c).alias("capacity_tokens"), "*") for n, c, x in _packed(spark, d)])


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every limit: documents placed, and how many containers are too full or documents of one container in two."""
    out = []
    for name, capacity, x in _packed(spark, d):
        full = x.groupBy("container").agg(F.sum("length").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"))
        cut = x.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("parts")).agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") <= capacity) & (F.col("parts") > 1)).alias("torn"))
        one = lambda df: df.withColumn("limit_name", F.lit(name))  # noqa: B023, E731
        out.append(one(cut).join(one(full), "limit_name").select("limit_name", "documents", "overfull", "torn"))
    return functools.reduce(DataFrame.unionByName, out)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents")).withColumn("text_key", F.concat_ws(":", F.xxhash64("text"), F.hash("text"), F.length("text")))
    sizes = materialise(tokens.token_counts(docs, extra=("source", "text_key")), "tokens")
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of every source of a mix: whether it has documents in the mix, and whether none is used too often."""
    return p9_shares(spark, d).select("mix_name", "source", (F.col("documents") > 0).alias("used"), (F.col("most_copies") <= F.col("max_repeats")).alias("within"))


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_clean, p3_found, p3_segments, p5_found, p5_bodies, p6_found, p6_neighbours, p6_search, p7_found, p7_pieces, p7_cover, p8_pack, p8_fill, p8_whole, p9_mix, p9_shares, p9_limits, p10_found, p10_canonical)}

_P5 = r"""
WITH docs AS (SELECT DISTINCT c.chunk_id, split_part(s.path, '/', 1) AS site, c.body
              FROM chunks c JOIN sources s USING (source_id) WHERE s.kind = 'docs' AND c.body IS NOT NULL),
parts AS (SELECT chunk_id, site, body, string_split(body, chr(10)) AS ls FROM docs),
lines AS (SELECT chunk_id, site, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM parts),
keyed AS (SELECT chunk_id, site, line_no, line, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM lines),
total AS (SELECT site, count(*) AS n FROM docs GROUP BY site),
often AS (SELECT site, k FROM keyed JOIN total USING (site) WHERE k <> '' GROUP BY site, k, n
          HAVING count(DISTINCT chunk_id) >= 5 AND count(DISTINCT chunk_id) * 100 >= n * 15)
"""
ORACLE = {
    "p5_found": _P5 + "SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (site, k)",
    "p5_bodies": _P5
    + """, hit AS (SELECT DISTINCT chunk_id, line_no FROM keyed JOIN often USING (site, k))
SELECT k.chunk_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no) FILTER (WHERE h.line_no IS NULL), '') AS body
FROM keyed k LEFT JOIN hit h USING (chunk_id, line_no) WHERE k.chunk_id IN (SELECT chunk_id FROM hit) GROUP BY k.chunk_id""",
    "p6_found": """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT a, b, s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM k WHERE s >= 0.9""",
    "p7_cover": r"""SELECT chunk_id, n AS n_chars, true AS fits, true AS overlaps, true AS whole FROM (SELECT DISTINCT c.chunk_id, length(regexp_replace(c.body, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS n
FROM chunks c JOIN sources s USING (source_id) JOIN split_limits l ON l.kind = s.kind) WHERE n > 0""",
    "p8_whole": "SELECT limit_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS torn FROM pack_limits",
    "p9_limits": """SELECT DISTINCT mix_name, source, source IN (SELECT source FROM documents WHERE text <> '') AS used, true AS within FROM mix_targets""",
    "p7_found": r"""SELECT DISTINCT c.chunk_id FROM chunks c JOIN sources s USING (source_id) JOIN split_limits l ON l.kind = s.kind
WHERE l.above > 0 AND length(regexp_replace(c.body, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) > l.above""",
}
