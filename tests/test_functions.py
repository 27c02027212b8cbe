from pyspark.sql import functions as F

from quire.functions import stem
from quire.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_language(spark):
    assert one(spark, T.language(F.col("t")), t="Слова и ещё слова") == "russian"
    assert one(spark, T.language(F.col("t")), t="words with one слово in it all") == "english"
    assert one(spark, T.language(F.col("t")), t="") == "english"


def test_length_floor_counts_bytes(spark):
    assert one(spark, T.too_short(F.col("t")), t="x" * 149)
    assert not one(spark, T.too_short(F.col("t")), t="ж" * 75)
    assert one(spark, T.too_short(F.col("t")), t="  \n " + "x" * 149 + " ")


def test_contents_and_index_pages(spark):
    contents = "\n".join(f"Chapter {i} . . . . . . {i}" for i in range(20))
    index = "\n".join(f"word {i}, {i}, {i + 3}" for i in range(20))
    prose = "\n".join("a plain line of text that goes on" for _ in range(20))
    assert [one(spark, T.front_or_back(F.col("t")), t=t) for t in (contents, index, prose)] == [True, True, False]


def test_unreadable(spark):
    plain = "The quick brown fox jumps over the lazy dog and runs away from here. " * 3
    shifted = "".join(chr(ord(c) - 29) if 33 + 29 <= ord(c) < 127 else c for c in plain)
    assert not one(spark, T.unreadable(F.col("t")), t=plain)
    assert one(spark, T.unreadable(F.col("t")), t="þæðøþæðøþ" * 10)
    assert one(spark, T.unreadable(F.col("t")), t="bcdfghjklm" * 10)
    assert one(spark, T.unreadable(F.col("t")), t=shifted)


def test_identifiers(spark):
    assert one(spark, T.find_doi(F.col("t")), t="see 10.1000/abc.def). More") == "10.1000/abc.def"
    assert one(spark, T.find_doi(F.col("t")), t="10.1000/abc") is None
    assert one(spark, T.find_arxiv(F.col("t")), t="arXiv:2101.00001v2 x") == "2101.00001v2"
    assert one(spark, T.first_isbn(F.col("t")), t="ISBN 978-0-306-40615-7 and ISBN 0-306-40615-2") == "9780306406157"
    assert one(spark, T.first_isbn(F.col("t")), t="ISBN 978-0-306-40615-8, ISBN: 0-306-40615-2") == "0306406152"
    assert one(spark, T.valid_isbn(F.col("t")), t="123456789X") is True
    assert one(spark, T.valid_isbn(F.col("t")), t="12345") is False


def test_titles_and_fingerprints(spark):
    assert one(spark, T.normalize_title(F.col("t")), t="  Ёлка — и ЁЖ, 2-е изд.") == "елка и еж 2 е изд"
    row = spark.createDataFrame([("10.1/ABCD", None, None, "T", 2000, "r"), (None, None, None, "A Title", 2001, "r"), ("", "", "", None, None, "Raw Line!")], "doi string, arxiv string, isbn string, title string, year int, raw string")
    got = [r.f for r in row.select(T.fingerprint(*[F.col(c) for c in row.columns]).alias("f")).collect()]
    assert got == ["10.1/abcd", "a title|2001", "raw:raw line"]


def test_locator(spark):
    df = spark.createDataFrame([("H > S", 3, 4), (None, None, None), (None, 5, None), (None, 203, 189), (None, 7, 7)], "h string, p int, n int")
    assert [r.x for r in df.select(T.locator(F.col("h"), F.col("p"), F.col("n")).alias("x")).collect()] == ["H > S", "", "PDF p. 5", "с. 189 (PDF 203)", "с. 7"]


def test_tags(spark):
    df = spark.createDataFrame([(1, ["nlp"]), (2, ["Work/Pet"]), (3, None)], "i int, tags array<string>")
    hit = lambda tag: [r.i for r in df.where(T.has_tag(F.col("tags"), tag)).collect()]
    assert [hit(t) for t in ("nlp", "NLP", "#work/", "work/pet", "wor", "pet", "")] == [[1], [1], [2], [2], [], [], [1, 2, 3]]


def test_slugs(spark):
    assert one(spark, T.slug(F.col("t")), t="Щукин Ёж") == "shchukinezh"
    assert one(spark, T.slug(F.col("t")), t="Müller–Straße Łódź") == "mullerstrasselodz"
    assert one(spark, T.manual_name(F.col("t")), t="..My manual (2)!") == "My-manual-2"


def test_plural_and_duration(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (11,), (21,), (112,)], "n int")
    assert [r.x for r in df.select(T.plural_ru(F.col("n"), "a", "b", "c").alias("x")).collect()] == ["a", "b", "c", "c", "a", "c"]
    df = spark.createDataFrame([(5,), (65,), (3700,), (90000,)], "n int")
    assert [r.x for r in df.select(T.short_duration(F.col("n")).alias("x")).collect()] == ["5s", "1m 5s", "1h 1m", "1d 1h"]


def test_stems():
    assert [stem.english(w) for w in "running flies happiness relational hopping hoping caresses generalization oscillators skis sky".split()] == "run fli happi relat hop hope caress general oscil ski sky".split()
    assert len({stem.russian(w) for w in "каталог каталога каталогу каталогами каталоги".split()}) == 1
    assert [stem.russian(w) for w in "важная важнейшие падает поднимаются пакетов".split()] == "важн важн пада поднима пакет".split()
    assert stem.terms("The Catalogues of the Library", "english") == ["catalogu", "librari"]
