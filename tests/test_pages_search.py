import pytest
from pyspark.sql import functions as F

from quire.operators import pages as P
from quire.operators import search as S


def folios(spark, pages):
    df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(pages)], "k string, page int, body string")
    return [r.printed for r in P.printed_pages(df, "k").orderBy("page").collect()]


def test_folios_follow_the_common_offset(spark):
    assert folios(spark, ["title"] * 2 + [f"{i}\ntext of the page" for i in range(1, 9)]) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert folios(spark, [f"[ {i + 10} ]\nbody" for i in range(2)]) == [0, 0]
    assert folios(spark, [f"text\n{i + 100}" for i in range(6)]) == [100, 101, 102, 103, 104, 105]
    assert folios(spark, ["a", "b"]) == [0, 0]


def test_pages_become_chunks(spark):
    good = "a page of text that is long enough to stay here. " * 5
    df = spark.createDataFrame([("f", 1, "short"), ("f", 2, good), ("f", 3, "ghjkl" * 40), ("f", 4, good)], "k string, page int, body string")
    assert [(r.ord, r.page) for r in P.page_chunks(df, "k").orderBy("ord").collect()] == [(1, 2), (2, 4)]
    assert P.scans(df, "k").first().scan is False


@pytest.fixture(scope="module")
def library(spark):
    chunks = spark.createDataFrame(
        [
            (1, 1, 1, "russian", ["nlp"], "Разделы о каталогах и сводках", "h1"),
            (2, 1, 2, "russian", ["Work/Pet"], "Каталог один раз", "h2"),
            (3, 2, 1, "english", None, "The catalogue of ordered snapshots keeps a catalogue", "h3"),
            (4, 2, 2, "english", ["nlp/deep"], "snapshots ordered by hand", "h3"),
            (5, 3, 1, "english", None, "nothing of the kind", None),
        ],
        "chunk_id long, source_id long, ord int, lang string, tags array<string>, body string, embed_hash string",
    )
    sources = spark.createDataFrame([(1, "vault", "a.md", "Каталоги", ["сводки"]), (2, "book", "b.pdf", "Plain", None), (3, "book", "c.pdf", "Catalogues", [])], "source_id long, kind string, path string, title string, aliases array<string>")
    vectors = spark.createDataFrame([("h1", [1.0, 0.0]), ("h2", [0.0, 1.0]), ("h3", [1.0, 1.0]), ("h9", None), ("h0", [0.0, 0.0])], "hash string, embedding array<float>")
    return chunks, sources, vectors


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_query_language():
    assert [[(c.terms, c.negated) for c in g] for g in S.parse('a "b c" -d or e')] == [[(("a",), False), (("b", "c"), False), (("d",), True)], [(("e",), False)]]
    assert S.parse("-only") == [] and S.parse("") == []


def test_inflected_query_finds_its_own_language(spark, library):
    chunks, sources, _ = library
    index = S.postings(chunks.select("chunk_id", "lang", "body"), stemmed=True).cache()
    assert ids(S.text_search(index, chunks, sources, S.Query("каталогами"), True)) == [1, 2]
    assert ids(S.text_search(index, chunks, sources, S.Query("catalogues snapshot"), True)) == [3]
    boosted = S.text_search(index, chunks, sources, S.Query("сводка"), True).first()
    assert boosted.chunk_id == 1 and boosted["rank"] == pytest.approx(0.4)  # the alias has just the query's term


def test_phrases_and_negation(spark, library):
    chunks, *_ = library
    index = S.postings(chunks.select("chunk_id", F.lit("simple").alias("lang"), "body")).cache()
    found = lambda q: sorted(ids(S.match(index, S.parse(q))))
    assert found('"ordered snapshots"') == [3]
    assert found("ordered snapshots") == [3, 4]
    assert found("snapshots -catalogue") == [4]
    assert found("nothing or hand") == [4, 5]
    assert found("absent") == [] and found("") == []


def test_order_is_the_same_at_every_limit(spark):
    chunks = spark.createDataFrame([(i, 1, i, "english", None, f"same words {c}", None) for i, c in enumerate("abcdef")], "chunk_id long, source_id long, ord int, lang string, tags array<string>, body string, embed_hash string")
    sources = spark.createDataFrame([(1, "book", "p", "t", None)], "source_id long, kind string, path string, title string, aliases array<string>")
    index = S.postings(chunks.select("chunk_id", F.lit("simple").alias("lang"), "body")).cache()
    assert {ids(S.text_search(index, chunks, sources, S.Query("same", limit=n)))[0] for n in (1, 2, 3, 10)} == {0}


def test_cover_density():
    assert S.cover_density([[1]]) == pytest.approx(0.1)
    assert S.cover_density([[1], [2]]) > S.cover_density([[1], [5]]) > 0
    assert S.cover_density([[1], []]) == 0
    assert S.cover_density([[1, 10], [2, 11]]) > S.cover_density([[1], [2]])


def test_headline_marks_hits():
    assert S.headline("a plain text with catalogues in it", {"catalogu"}, "english") == "a plain text with <<catalogues>> in it"


def test_vectors(spark, library):
    chunks, sources, vectors = library
    q = S.Query("", limit=10, vector=[1.0, 0.0])
    assert [(r.chunk_id, r["rank"]) for r in S.vector_chunks(vectors, chunks, sources, q).collect()] == [(1, 1.0), (3, 0.707107), (4, 0.707107), (2, 0.0)]
    assert ids(S.vector_chunks(vectors, chunks, sources, S.Query("", tag="nlp", vector=[1.0, 0.0]))) == [1, 4]


def test_fusion_and_cap(spark):
    leg = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "chunk_id long, pos int")
    fused = S.fuse([leg([1, 2, 3]), leg([4, 2, 5])]).orderBy(F.desc("rank"), "chunk_id")
    assert ids(fused)[0] == 2 and fused.count() == 5
    hits = spark.createDataFrame([(1, "p", 4.0), (2, "p", 3.0), (3, "p", 2.0), (4, "q", 1.0)], "chunk_id long, path string, rank double")
    assert sorted(ids(S.cap_per_source(hits, 1))) == [1, 4]


def test_hybrid_without_vector_and_rerank(spark, library):
    chunks, sources, vectors = library
    index = S.postings(chunks.select("chunk_id", F.lit("simple").alias("lang"), "body")).cache()
    assert ids(S.hybrid(index, vectors, chunks, sources, S.Query("ordered"))) == [3, 4]
    backwards = lambda q, docs: [float(i) for i in range(len(docs))]
    assert ids(S.hybrid(index, vectors, chunks, sources, S.Query("ordered", rerank=True), scorer=backwards)) == [4, 3]

    def broken(q, docs):
        raise RuntimeError

    assert ids(S.hybrid(index, vectors, chunks, sources, S.Query("ordered", rerank=True), scorer=broken)) == [3, 4]


def test_limits():
    assert [S.clamp_limit(n) for n in (0, 1, 50, 51)] == [10, 1, 50, 10]
    assert (S.overfetch(10, 1), S.overfetch(20, 1), S.overfetch(5, 0, True), S.leg_depth(10), S.leg_depth(10, 900)) == (50, 50, 20, 20, 500)


def test_passage(spark, library):
    chunks, *_ = library
    r = S.read_passage(chunks, 2).first()
    assert r.previous.startswith("Разделы") and r.next is None


def test_ranges_equal_plain_windows(spark):
    """A hot key over several ranges, gaps in the order, null values, an empty table."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quire.runtime import ranged_neighbours, ranged_row_number

    rows = [(k, i * 7 if i < 400 else i * 900, None if i % 5 == 0 else f"{k}{i}", "x") for k in ("hot", "cold") for i in range(600 if k == "hot" else 3)]
    df = spark.createDataFrame(rows, "k string, o long, v string, _clash string")
    w = Window.partitionBy("k").orderBy("o")
    want = {(r.k, r.o): (r.p, r.q, r.n) for r in df.select("k", "o", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("q"), F.row_number().over(w).alias("n")).collect()}
    near = {(r.k, r.o): (r._before, r._after) for r in ranged_neighbours(df, "k", "o", F.col("v"), F.col("v")).collect()}
    numbered = {(r.k, r.o): r.n for r in ranged_row_number(df, "k", "o", "n").collect()}
    assert near == {k: x[:2] for k, x in want.items()} and numbered == {k: x[2] for k, x in want.items()}
    assert ranged_neighbours(df.where("false"), "k", "o", F.col("v"), F.col("v")).count() == 0


def test_snippets_come_with_hits(spark):
    from pyspark.sql import functions as F

    from quire.operators import search as S

    df = spark.createDataFrame([(1, "One ordered ledger among many words."), (2, None), (3, "")], "i long, body string")
    got = {r.i: r.s for r in df.select("i", S.snippet(F.col("body"), S.Query("ordered ledger -gone")).alias("s")).collect()}
    assert got[1] == "One <<ordered>> <<ledger>> among many words" and not got[2] and not got[3]
