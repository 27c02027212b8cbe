import pytest
from pyspark.sql import functions as F

from quire.functions import display as D
from quire.operators import embedding as M


def fake(texts):
    if any("bad" in t for t in texts):
        raise ValueError("refused")
    if any(len(t) > 200 for t in texts):
        raise M.TooLong
    return [[float(len(t)), 1.0] for t in texts]


def test_batches():
    assert M.embed_batch(fake, ["a", "bb"]) == [([1.0, 1.0], None, True), ([2.0, 1.0], None, True)]
    got = M.embed_batch(fake, ["a", "bad", "x" * 300])
    assert got[0][0] == [1.0, 1.0] and got[1] == (None, "ValueError: refused", True) and got[2][0] == [150.0, 1.0]
    waits = []

    def gone(texts):
        raise M.Unavailable("down")

    assert M.embed_batch(gone, ["a"], sleep=waits.append) == [(None, "unavailable: down", False)] and waits == [0.5, 1.0, 2.0]
    with pytest.raises(M.TooLong):
        M.shortened(lambda t: (_ for _ in ()).throw(M.TooLong()), "x" * 1000)


def test_queue(spark):
    q = spark.createDataFrame([("h1", "text"), ("h2", "bad"), ("h1", "text")], "hash string, window string")
    done = M.embed(q, fake)
    old = spark.createDataFrame([("h2", None, 1, None, None), ("h3", [1.0], 1, None, None)], "hash string, embedding array<float>, attempts int, embedded_at timestamp, last_error string")
    got = {r.hash: r for r in M.absorb(old, done, F.current_timestamp()).collect()}
    assert got["h1"].embedding == [4.0, 1.0] and got["h1"].attempts == 1 and got["h1"].embedded_at is not None
    assert got["h2"].attempts == 2 and got["h2"].last_error == "ValueError: refused" and got["h3"].attempts == 1


def test_breaker():
    now, answers = [0.0], []

    def model(texts):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return [x]

    b = M.Breaker(model, lambda: now[0])
    answers += [[1.0], TimeoutError(), [2.0], TimeoutError(), TimeoutError()]
    assert [b("q") for _ in range(5)] == [[1.0], None, [2.0], None, None]
    assert b("q") is None and not answers  # open: the model isn't asked
    now[0] = 31
    answers.append(ValueError())
    assert b("q") is None and b("q") is None
    now[0] = 62
    answers.append([3.0])
    assert b("q") == [3.0]


def test_display():
    assert D.segments("a <<b>> c") == [("a ", False), ("b", True), (" c", False)] and D.segments("") == []
    assert D.blocks("p\n```py\ncode\n```\nq") == [("p", False), ("code", True), ("q", False)]
    assert D.source_address("book", "a b.pdf", 3) == "/files/book/a%20b.pdf#page=3" and D.source_address("docs", "x.html", None, "s") == "/files/docs/x.html#s"
    assert D.changes({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": ""}) == {"b": (2, 3)}
    assert D.cited_page("с. 12 (PDF 14)") == "12" and D.cited_page("H") is None
    assert D.latex_citation("k", "с. 5") == "\\cite[5]{k}" and D.pandoc_citation("k") == "[@k]" and D.title_language("Книга A") == "ru-RU"
