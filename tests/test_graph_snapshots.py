from datetime import datetime

from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import journal as J
from quire.operators import snapshots as S


def test_resolution(spark):
    sources = spark.createDataFrame([(1, "paper", "p1", "hp"), (2, "book", "b1", "hb"), (3, "book", "a1", "hp"), (4, "paper", "p2", "me")], "source_id long, kind string, path string, hash string")
    described = spark.createDataFrame(
        [("hp", "paper", "10.1/ABCDE", None, "A work of note", 2001), ("hb", "book", None, "9780306406157", "Another work", 2002), ("me", "paper", "10.9/selfref", None, "My own paper here", 2020)],
        "key string, kind string, doi string, isbn string, title string, year int",
    )
    heads = spark.createDataFrame([("hb", "xxquiet rivers of the north by some authors"), ("me", "my own paper here")], "hash string, head string")
    c = spark.createDataFrame(
        [
            ("me", "references", 1, "10.1/abcde", None, None, None, None, None),
            ("me", "references", 2, None, None, "a WORK of note!", 2001, None, None),
            ("me", "references", 3, None, None, "a work of note", 1999, None, None),
            ("me", "references", 4, None, "0306406157", None, None, None, None),
            ("me", "references", 5, None, None, "quiet rivers of the north", None, None, None),
            ("me", "references", 6, None, None, "rivers of the", None, None, None),
            ("me", "references", 7, "10.9/selfref", None, None, None, None, None),
            ("me", "references", 8, None, None, "gone", None, "old", "title"),
        ],
        "paper string, list string, ord int, doi string, isbn string, title string, year int, resolved string, matched_by string",
    )
    got = {r.ord: (r.resolved, r.matched_by) for r in G.resolve(c, described, heads, sources).collect()}
    assert got == {1: ("hp", "doi"), 2: ("hp", "title"), 3: (None, None), 4: ("hb", "isbn"), 5: ("hb", "page"), 6: (None, None), 7: (None, None), 8: ("old", "title")}
    assert G.resolve(c, described, heads, sources, keep=False).where("ord = 8").first().resolved is None
    assert [r.path for r in G.best_sources(sources).where("hash = 'hp'").collect()] == ["p1"]


def test_note_citations(spark):
    notes = spark.createDataFrame([("n1", "see *Quiet Rivers*, с. 12 and *Loud*, с. 3"), ("n2", "*Quiet Riv*, с. 1")], "note string, text string")
    titles = spark.createDataFrame([(1, "Quiet rivers of the north"), (2, "Quiet Rivers")], "place long, title string")
    t = G.tally(G.note_citations(notes, titles)).first()
    assert (t.citations, t.library, t.sources, t.notes) == (2, 1, 1, 1)


def test_embed_windows(spark):
    chunks = spark.createDataFrame([(1, 1, 1, None, "one"), (2, 1, 2, None, ""), (3, 1, 3, "H", "three"), (4, 2, 1, "S", "note")], "chunk_id long, source_id long, ord int, heading string, body string")
    sources = spark.createDataFrame([(1, "book", "T"), (2, "vault", "N")], "source_id long, kind string, title string")
    got = {r.chunk_id: r.window for r in S.embed_windows(chunks, sources).collect()}
    assert got == {1: "one", 2: "one  three", 3: "three", 4: "N > S note"}


def test_queue_and_quarantine(spark):
    chunks = spark.createDataFrame([(2, 1, "a"), (1, 2, "b"), (1, 1, "c"), (1, 3, "c"), (1, 4, "d")], "source_id long, ord int, embed_hash string")
    vectors = spark.createDataFrame([("b", [1.0], 1, None), ("d", None, 3, "refused")], "hash string, embedding array<double>, attempts int, last_error string")
    assert [(r.hash, r.ord) for r in S.queue(chunks, vectors, 5).collect()] == [("c", 1)]
    p = {r.source_id: (r.chunks, r.embedded, r.quarantined) for r in S.progress(chunks, vectors).collect()}
    assert p == {1: (4, 1, 1), 2: (1, 0, 0)}
    again = S.requeue(vectors).where("hash = 'd'").first()
    assert again.attempts == 0 and again.last_error is None
    less = {r.hash: r.attempts for r in S.attempted(vectors, spark.createDataFrame([("b",), ("z",)], "hash string"), -1).collect()}
    assert less == {"b": 0, "d": 3, "z": 0}


def test_files(spark):
    sources = spark.createDataFrame([(1, "book", "a", "h1", 2), (2, "book", "b", "h2", 1), (3, "docs", "c", "h3", 2)], "source_id long, kind string, path string, hash string, rules int")
    found = spark.createDataFrame([("book", "a", "h1"), ("book", "new", "h2")], "kind string, path string, hash string")
    assert [r.path for r in S.unchanged(found, sources, 2).collect()] == ["a"]
    assert [(r.source_id, r.path) for r in S.renamed(found, sources).collect()] == [(2, "new")]
    assert sorted(r.source_id for r in S.prune(sources, found, "book").collect()) == [1, 3]
    assert S.prune(sources, found, "docs").count() == 3  # nothing found: the walk failed


def test_merge_newer(spark):
    old = spark.createDataFrame([("k1", "a", "x", 5), ("k2", "b", "x", 5)], "key string, citekey string, v string, updated_at int")
    new = spark.createDataFrame([("k1", "a", "y", 5), ("k2", "b", "y", 6), ("k3", "a", "y", 9), ("k4", "c", "y", 1)], "key string, citekey string, v string, updated_at int")
    assert {r.key: r.v for r in S.merge_newer(old, new).collect()} == {"k1": "x", "k2": "y", "k4": "y"}


def test_citekeys(spark):
    r = spark.createDataFrame([("1", "Ёлкин", "T", 2000, "draft", ""), ("2", "Елкин", "T", 2000, "draft", ""), ("3", None, "The Art of", None, "draft", ""), ("4", None, None, None, "checked", "elkin2000b"), ("5", "", "", 0, "draft", "")], "key string, family string, title string, year int, status string, citekey string")
    assert {x.key: x.citekey for x in S.citekeys(r).collect()} == {"1": "elkin2000", "2": "elkin2000a", "3": "art", "4": "elkin2000b", "5": "ref"}


def test_usage(spark):
    t = lambda m: datetime(2025, 1, 1, 12, m)
    s = spark.createDataFrame([(1, t(0), "mcp", [7, 8], ""), (2, t(1), "mcp", [], ""), (3, t(2), "mcp", None, "x"), (4, t(0), "http", [7], "")], "search_id long, at timestamp, origin string, hits array<long>, err string")
    r = spark.createDataFrame([(t(10), "mcp", 8), (t(31), "http", 7)], "at timestamp, origin string, chunk_id long")
    assert {x.origin: (x.searches, x.empty, x.failed, x.read) for x in J.usage(s, r).collect()} == {"mcp": (3, 1, 1, 1), "http": (1, 0, 0, 0)}
    assert [x.search_id for x in J.listed(s, 0).collect()] == [3, 2, 4, 1]
    alive = J.pulse(s.select("at"), F.lit(datetime(2025, 1, 1, 12, 3))).first()
    assert alive.silence == 60 and alive.alive
