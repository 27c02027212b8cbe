"""Full-text, vector and hybrid search over chunks.

Terms of a text are its runs of letters and digits, lower-cased; with a language given they are stemmed and stop words
are left out. An index is a table of postings (term, chunk_id, positions), meant to be stored partitioned by a hash of
the term. Queries are parsed on the driver; matching is joins of a few terms' postings, never a scan of texts.
Ties are broken by chunk id everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import stem as S
from quire.functions import text as T
from quire.runtime import maybe_broadcast, ranged_neighbours

RRF_K = 60
DEFAULT_LIMIT, MAX_LIMIT, MAX_DEPTH, RERANKED = 10, 50, 500, 20


# ---- knobs ----------------------------------------------------------------------------------------------------------


def clamp_limit(n: int) -> int:
    """A limit out of 1..50 becomes 10."""
    return n if 1 <= n <= MAX_LIMIT else DEFAULT_LIMIT


def overfetch(limit: int, per_source: int = 0, rerank: bool = False) -> int:
    n = min(5 * limit, MAX_LIMIT) if per_source > 0 else limit
    return max(n, RERANKED) if rerank else n


def leg_depth(limit: int, depth: int = 0) -> int:
    return min(depth, MAX_DEPTH) if depth > 0 else 2 * limit


@dataclass(frozen=True)
class Query:
    text: str
    kind: str = ""
    mode: str = "hybrid"
    limit: int = DEFAULT_LIMIT
    per_source: int = 0
    normalization: int = 0
    title_boost: float = 0.3
    depth: int = 0
    tag: str = ""
    rerank: bool = False
    vector: list[float] | None = field(default=None, repr=False)


# ---- query language -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """Terms that must follow each other; one term alone is a phrase of one."""

    terms: tuple[str, ...]
    negated: bool = False


def parse(text: str, language: str = "simple") -> list[list[Clause]]:
    """Words are joined by and; ``or`` between words, ``"a phrase"`` and ``-not`` are understood. Alternatives of clauses."""
    groups: list[list[Clause]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        word = m.group(4)
        if word is not None and word.lower() == "or" and not m.group(3):
            groups.append([])
            continue
        terms = tuple(S.terms(m.group(2) if m.group(2) is not None else word, language))
        if terms:
            groups[-1].append(Clause(terms, (m.group(1) or m.group(3)) == "-"))
    return [g for g in groups if any(not c.negated for c in g)]


# ---- index ----------------------------------------------------------------------------------------------------------


def token_array(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"word": b["word"], "lang": b["lang"], "term": [S.stem(w, x) for w, x in zip(b["word"], b["lang"], strict=True)]})


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, lang) -> (word, lang, term) for each distinct pair; a stop word has no term."""
    return words.select("word", "lang").distinct().mapInPandas(_stems, "word string, lang string, term string")


def query_terms(q: Query, stemmed: bool) -> list[str]:
    """All terms, required or not wanted, that a query looks up."""
    return sorted({t for x in (("russian", "english") if stemmed else ("simple",)) for g in parse(q.text, x) for c in g for t in c.terms})


def postings(texts: DataFrame, stemmed: bool = False, only: list[str] | None = None) -> DataFrame:
    """(chunk_id, lang, body) -> (term, chunk_id, lang, positions from 1). Each distinct word is stemmed once.

    ``only`` keeps the postings of some terms: for a query without a stored index, so that just these are shuffled.
    """
    each = texts.select("chunk_id", "lang", F.posexplode(token_array(F.col("body"))).alias("p", "word")).select("chunk_id", "lang", (F.col("p") + 1).alias("pos"), "word")
    if stemmed:
        terms = vocabulary(each).where("term IS NOT NULL")
        terms = terms if only is None else maybe_broadcast(terms.where(F.col("term").isin(only)))
        each = each.join(terms, ["word", "lang"])
    else:
        each = each.withColumnRenamed("word", "term")
        each = each if only is None else each.where(F.col("term").isin(only))
    return each.groupBy("term", "chunk_id", "lang").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("tf"))


# ---- matching -------------------------------------------------------------------------------------------------------


def _phrase(index: DataFrame, clause: Clause) -> DataFrame:
    """(chunk_id, starts): where the clause's terms follow each other."""
    out = None
    for k, t in enumerate(clause.terms):
        one = index.where(F.col("term") == t).select("chunk_id", F.transform("positions", lambda p: p - k).alias(f"s{k}"))  # noqa: B023
        out = one if out is None else out.join(one, "chunk_id")
    starts = F.col("s0")
    for k in range(1, len(clause.terms)):
        starts = F.array_intersect(starts, F.col(f"s{k}"))
    return out.select("chunk_id", starts.alias("starts")).where(F.size("starts") > 0)


def match(index: DataFrame, groups: list[list[Clause]]) -> DataFrame:
    """chunk_id of the chunks that a parsed query matches."""
    found = None
    for g in groups:
        terms = sorted({c.terms[0] for c in g if not c.negated and len(c.terms) == 1})
        some = None
        if terms:  # all single terms in one pass over their postings
            some = index.where(F.col("term").isin(terms)).groupBy("chunk_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select("chunk_id")
        for c in g:
            if not c.negated and len(c.terms) > 1:
                p = _phrase(index, c).select("chunk_id")
                some = p if some is None else some.join(p, "chunk_id", "left_semi")
        for c in g:
            if c.negated:
                some = some.join(_phrase(index, c).select("chunk_id"), "chunk_id", "left_anti")
        found = some if found is None else found.unionByName(some)
    return found.distinct() if found is not None else index.select("chunk_id").where("false")


def cover_density(positions: list[list[int]]) -> float:
    """Sum over minimal covers of all terms of 1 / (extra width + 1), a tenth each (the weight of plain text).

    Covers are found by sliding from each end position to the latest start (Clarke, Cormack and Tudhope, 2000).
    """
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted((p, k) for k, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    total, before = 0.0, None
    for p, k in events:
        last[k] = p
        if len(last) == len(positions):
            start = min(last.values())
            if start != before:
                total += 0.1 / max(1, p - start - len(positions) + 2)
                before = start
    return total


def normalised(rank: float, length: int, uniques: int, how: int) -> float:
    """Divides by functions of length as a bit mask says: 1 log, 2 length, 8 unique words, 16 their log, 32 rank + 1."""
    import math

    if how & 1:
        rank /= 1 + math.log(max(1, length))
    if how & 2:
        rank /= max(1, length)
    if how & 8:
        rank /= max(1, uniques)
    if how & 16:
        rank /= 1 + math.log(max(1, uniques))
    return rank / (rank + 1) if how & 32 else rank


def rank(index: DataFrame, found: DataFrame, groups: list[list[Clause]], how: int = 0) -> DataFrame:
    """(chunk_id, rank) of matched chunks by cover density of the query's terms."""
    terms = sorted({t for g in groups for c in g if not c.negated for t in c.terms})
    rows = index.where(F.col("term").isin(terms)).join(found, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "positions")).alias("ps"))
    need = [[t for c in g if not c.negated for t in c.terms] for g in groups]
    if how & ~32:
        sizes = index.join(found, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("length"), F.count(F.lit(1)).alias("uniques"))
        rows = rows.join(sizes, "chunk_id")
    else:
        rows = rows.withColumn("length", F.lit(1).cast("long")).withColumn("uniques", F.lit(1).cast("long"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ps, n, u in zip(b["ps"], b["length"], b["uniques"], strict=True):
                at = {x["term"]: list(x["positions"]) for x in ps}
                out.append(normalised(max(cover_density([at.get(t, []) for t in dict.fromkeys(g)]) for g in need), int(n), int(u), how))
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "rank": out})

    return rows.mapInPandas(score, "chunk_id long, rank double")


def headline(body: str, terms: set[str], language: str, words: int = 28, fragments: int = 2) -> str:
    """Up to two fragments of up to 28 words around hits, hits in << >>."""
    tokens = list(re.finditer(r"[^\W_]+", body))
    hits = [i for i, m in enumerate(tokens) if S.stem(m.group().lower(), language) in terms]
    out, upto = [], -1
    for h in hits:
        if len(out) == fragments:
            break
        if h <= upto:
            continue
        a, upto = max(0, h - words // 4), min(len(tokens) - 1, max(0, h - words // 4) + words - 1)
        text, at = "", tokens[a].start()
        for i in range(a, upto + 1):
            m = tokens[i]
            text += body[at : m.start()] + (f"<<{m.group()}>>" if i in hits else m.group())
            at = m.end()
        out.append(text)
    return " ... ".join(out)


def snippet(body: Column, q: Query, stemmed: bool = False) -> Column:
    """The headline of each hit for a query's terms, for the few rows of a page of results."""
    languages = ("russian", "english") if stemmed else ("simple",)
    terms = {x: {t for g in parse(q.text, x) for c in g if not c.negated for t in c.terms} for x in languages}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def best(text: str | None) -> str:
            found = [headline(text or "", t, x) for x, t in terms.items()]
            return max(found, key=lambda f: f.count("<<"), default="")

        return texts.map(best)

    return run(body)


def filtered(chunks: DataFrame, sources: DataFrame, kind: str = "", tag: str = "") -> DataFrame:
    """Chunks of a kind of source and with a tag."""
    out = chunks.join(sources.select("source_id", "kind", F.col("title").alias("source_title"), "path"), "source_id")
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.where(T.has_tag(F.col("tags"), tag)) if T.clean_tag(tag) else out


def text_search(index: DataFrame, chunks: DataFrame, sources: DataFrame, q: Query, stemmed: bool = False) -> DataFrame:
    """(chunk_id, rank), best first: matched in the chunk's own language, titles and aliases that match boosted."""
    languages = ("russian", "english") if stemmed else ("simple",)
    ranked = None
    for lang in languages:
        groups = parse(q.text, lang)
        if not groups:
            continue
        own = index.where(F.col("lang") == lang) if stemmed else index
        r = rank(own, match(own, groups), groups, q.normalization).withColumn("ql", F.lit(lang))
        ranked = r if ranked is None else ranked.unionByName(r)
    if ranked is None:
        return chunks.select("chunk_id", F.lit(0.0).alias("rank")).where("false")
    hits = filtered(chunks.select("chunk_id", "source_id", "tags"), sources, q.kind, q.tag).join(ranked, "chunk_id")
    boosted = boosts(sources, q, languages)
    if boosted is not None:
        hits = hits.join(boosted, ["source_id", "ql"], "left").withColumn("rank", F.col("rank") + F.coalesce("boost", F.lit(0.0)))
    return hits.select("chunk_id", "rank").orderBy(F.desc("rank"), "chunk_id").limit(q.limit)


def boosts(sources: DataFrame, q: Query, languages: tuple[str, ...]) -> DataFrame | None:
    """(source_id, ql, boost): the title holds all the query's terms, or an alias has just the same ones."""
    wanted = {x: sorted({t for g in parse(q.text, x) for c in g if not c.negated for t in c.terms}) for x in languages}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, title, aliases in zip(b["source_id"], b["title"], b["aliases"], strict=True):
                for lang, terms in wanted.items():
                    n = int(bool(terms) and set(terms) <= set(S.terms(title or "", lang)))
                    n += int(any(set(S.terms(a or "", lang)) == set(terms) for a in (aliases if aliases is not None else [])))
                    if n:
                        rows.append((i, lang, q.title_boost * n))
            yield pd.DataFrame(rows, columns=["source_id", "ql", "boost"])

    return sources.select("source_id", "title", "aliases").mapInPandas(run, "source_id long, ql string, boost double") if q.title_boost else None


# ---- vectors --------------------------------------------------------------------------------------------------------


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine with a literal vector, in the JVM; null for null, zero or other-sized vectors."""
    lit = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(x * x for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(a, lit, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return F.when((F.size(a) == len(query)) & (size > 0) & F.lit(norm > 0), dot / (size * norm))


def vector_search(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id") -> DataFrame:
    """(key, rank): the most similar vectors, exactly; a partial top-k per partition is all that is shuffled."""
    scored = vectors.select(key, F.round(cosine(F.col("embedding"), query), 6).alias("rank")).where("rank IS NOT NULL")
    return scored.orderBy(F.desc("rank"), key).limit(limit)


def vector_chunks(vectors: DataFrame, chunks: DataFrame, sources: DataFrame, q: Query) -> DataFrame:
    """(chunk_id, rank) by the vectors filed under the chunks' keys; a kind or tag narrows the chunks first."""
    narrowed = filtered(chunks.select("chunk_id", "source_id", "tags", F.col("embed_hash").alias("hash")), sources, q.kind, q.tag).select("chunk_id", "hash").distinct()
    scored = vectors.where("embedding IS NOT NULL").select("hash", F.round(cosine(F.col("embedding"), q.vector), 6).alias("rank")).where("rank IS NOT NULL")
    return narrowed.join(scored, "hash").select("chunk_id", "rank").orderBy(F.desc("rank"), "chunk_id").limit(q.limit)


# ---- lists ----------------------------------------------------------------------------------------------------------


def positions(hits: DataFrame) -> DataFrame:
    """Adds pos from 1 in rank order; hits are at most a leg's depth."""
    return hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rank"), "chunk_id")))


def fuse(legs: list[DataFrame]) -> DataFrame:
    """Reciprocal rank fusion of lists (chunk_id, pos): (chunk_id, rank)."""
    out = None
    for leg in legs:
        one = leg.select("chunk_id", (1.0 / (RRF_K + F.col("pos"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("chunk_id").agg(F.sum("part").alias("rank"))


def cap_per_source(hits: DataFrame, n: int, by: str = "path") -> DataFrame:
    """The first n hits of each path in rank order."""
    if n <= 0:
        return hits
    w = Window.partitionBy(by).orderBy(F.desc("rank"), "chunk_id")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def hybrid(index: DataFrame, vectors: DataFrame, chunks: DataFrame, sources: DataFrame, q: Query, stemmed: bool = False, scorer: Callable | None = None) -> DataFrame:
    """Both legs, fused, reranked if a scorer is given, capped by path, cut to the limit. Without a vector the text leg alone."""
    limit = clamp_limit(q.limit)
    wide = overfetch(limit, q.per_source, q.rerank and scorer is not None)
    deep = replace(q, limit=leg_depth(wide, q.depth))
    text = text_search(index, chunks, sources, deep, stemmed)
    legs = [positions(text)] + ([positions(vector_chunks(vectors, chunks, sources, deep))] if q.vector else [])
    fused = (fuse(legs) if len(legs) > 1 else text).orderBy(F.desc("rank"), "chunk_id").limit(wide)
    # only the bodies of the hits, at most as many as are fetched, are moved
    own = chunks.select("chunk_id", "source_id", "body").join(F.broadcast(fused.select("chunk_id")), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    hits = fused.join(own, "chunk_id").join(sources.select("source_id", "path", "title"), "source_id")
    if q.rerank and scorer is not None:
        hits = rerank(hits, q.text, scorer)
    return cap_per_source(hits, q.per_source).orderBy(F.desc("rank"), "chunk_id").limit(limit).select("chunk_id", "path", "title", "rank", snippet(F.col("body"), q, stemmed).alias("snippet"))


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], top: int = RERANKED) -> DataFrame:
    """The first hits in the order of an injected scorer, the rest after them; any failure keeps the order."""
    rows = hits.orderBy(F.desc("rank"), "chunk_id").limit(MAX_LIMIT).collect()  # at most fifty hits
    head, tail = rows[:top], rows[top:]
    if len(head) > 1:
        try:
            scores = scorer(query, [f"{r.title}\n{(r.body or '')[:1500]}" for r in head])
            if len(scores) == len(head):
                head = [r for _, _, r in sorted(((-s, i, r) for i, (s, r) in enumerate(zip(scores, head, strict=True))), key=lambda x: x[:2])]
        except Exception:  # noqa: BLE001, S110
            pass
    order = [(r.chunk_id, float(len(rows) - i)) for i, r in enumerate(head + tail)]
    new = hits.sparkSession.createDataFrame(order, "chunk_id long, rank double")
    return hits.drop("rank").join(F.broadcast(new), "chunk_id")


def compare(index: DataFrame, vectors: DataFrame, chunks: DataFrame, sources: DataFrame, q: Query, stemmed: bool = False) -> dict[str, DataFrame]:
    """The two legs and their fusion, each with positions."""
    deep = replace(q, limit=leg_depth(clamp_limit(q.limit)))
    text, vector = positions(text_search(index, chunks, sources, deep, stemmed)), positions(vector_chunks(vectors, chunks, sources, deep))
    return {"text": text, "vector": vector, "hybrid": positions(fuse([text, vector]))}


# ---- reading --------------------------------------------------------------------------------------------------------


def passages(chunks: DataFrame) -> DataFrame:
    """Every chunk with the bodies before and after it in its source."""
    beside = ranged_neighbours(chunks.select("chunk_id", "source_id", "ord", "body"), "source_id", "ord", F.col("body"), F.col("body"))
    return beside.select("chunk_id", "source_id", "ord", "body", F.col("_before").alias("previous"), F.col("_after").alias("next"))


def read_passage(chunks: DataFrame, chunk_id: int) -> DataFrame:
    """One chunk with its neighbours; only its source is read."""
    here = chunks.where(F.col("chunk_id") == chunk_id).select("source_id").distinct()
    return passages(chunks.join(F.broadcast(here), "source_id", "left_semi").dropDuplicates(["chunk_id"])).where(F.col("chunk_id") == chunk_id)


def bodies(chunks: DataFrame, ids: list[int], chars: int) -> DataFrame:
    return chunks.where(F.col("chunk_id").isin(ids)).select("chunk_id", F.substring("body", 1, chars).alias("body")).distinct()


def indexed_text(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with the text that is indexed: a source's aliases go with its first chunk only; headings do not."""
    first = chunks.groupBy("source_id").agg(F.min("ord").alias("_first"))
    j = chunks.join(first, "source_id").join(sources.select("source_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("_a")), "source_id")
    extra = (F.col("ord") == F.col("_first")) & (F.size("_a") > 0)
    return j.withColumn("body", F.when(extra, F.concat_ws(" ", "body", F.array_join("_a", " "))).otherwise(F.col("body"))).select(chunks.columns)
