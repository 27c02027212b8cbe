import io
import json
import math
import random
import struct
import tracemalloc
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import bibliography as B
from quire.operators import evaluation as E
from quire.operators import multivalue as M
from quire.operators import references as R
from quire.sources import ebooks, markup


def test_entries():
    p = R.parse('[3] J. Smith and A. Lee. A title of some length. Journal of Things, 2004. doi:10.1000/xyz12.')
    assert (p["label"], p["authors"], p["title"], p["year"], p["doi"]) == ("[3]", "J. Smith and A. Lee", "A title of some length", 2004, "10.1000/xyz12")
    p = R.parse("Иванов, И. И. (2010). Название работы. Издательство.")
    assert (p["authors"], p["title"], p["year"]) == ("Иванов, И. И.", "Название работы", 2010)
    p = R.parse("Lee A. “Quoted title here,” Proc. of X, 1999.")
    assert (p["authors"], p["title"], p["year"]) == ("Lee A", "Quoted title here", 1999)
    assert R.parse("just some words")["title"] is None
    assert R.parse("X. Y. Z. arXiv:2001.01234, 2020")["arxiv"] == "2001.01234"


def test_entries_of_the_library():
    rows = duckdb.connect().execute("SELECT DISTINCT raw, label, doi, title, year FROM '/root/testdata/sf0.01/citations.parquet' WHERE title IS NOT NULL AND year IS NOT NULL").fetchall()
    got = [R.parse(r[0]) for r in rows]
    assert sum(p["label"] == r[1] for p, r in zip(got, rows)) > 0.99 * len(rows)
    assert sum(p["doi"] == r[2] for p, r in zip(got, rows)) > 0.99 * len(rows)
    assert sum(p["year"] == r[4] for p, r in zip(got, rows)) > 0.95 * len(rows)


def test_lists():
    pages = ["Intro\nHead 1\ntext", "R E F E R E N C E S\n[1] A. B. First en-\ntry. 2001.\n[2] C. D. Second. 2002.\n17\nHead 2", "[3] E. F. Third. 10.1000/abc-\ndef. 2003.\nAppendix A\nmore"]
    assert R.lists(pages) == [("references", ["[1] A. B. First entry. 2001.", "[2] C. D. Second. 2002.", "[3] E. F. Third. 10.1000/abc-def. 2003."])]
    hanging = ["References\nSmith, A. First work about things.\n   Place, 2001.\nLee, B. Second work.\n   2002."]
    assert [len(e) for _, e in R.lists(hanging)] == [2]
    primary = ["Primary studies\n[P1] A. B. One. 2001.\n[P2] C. D. Two. 2002.\n[P3] E. F. Three. 2003."]
    assert [k for k, _ in R.lists(primary)] == ["primary"]
    assert R.lists(["As references to earlier work show\nnothing"]) == [] and R.lists([]) == []


@pytest.mark.parametrize("after", ["\nA Proofs of the theorems\nWe prove it.", "\nSUPPLEMENTARY MATERIAL\nmore text", "\nAnn B. Lee is a professor of things.", "Index\nword 3"])
def test_lists_end(after):
    labelled = "References\n[1] A. Lee. First work. 2001.\n[2] B. Roe. Second work. 2002.\n" + after
    assert R.lists([labelled]) == [("references", ["[1] A. Lee. First work. 2001.", "[2] B. Roe. Second work. 2002."])]
    hanging = "References\nLee, A. First work about\n   things. 2001.\nRoe, B. Second work.\n   Place, 2002.\n" + after
    assert [len(e) for _, e in R.lists([hanging])] == [2]


def test_pages_without_lists():
    pages = ["Text of it.\nSee references there.", "More.\nReferences\n[1] A. Lee. First work. 2001.\n[2] B. Roe. Second", "work. 2002.\nAppendix A\nproofs"]
    assert R.without_lists(pages) == [pages[0], "More.\n\n\n", "\nAppendix A\nproofs"]
    assert R.without_lists([]) == [] and R.without_lists(["", "References"]) == ["", "References"]


def test_lists_go_on_over_headings_within():
    pages = ["References\n[1] A. Lee. First work. 2001.\n[2] B. Roe. Second work. 2002.", "RUNNING HEAD OF ONE PAGE\n[3] C. Poe. Third. 2003."]
    assert len(R.lists(pages)[0][1]) == 3


def test_notes():
    text = "---\ntags: [a, '#b']\naliases:\n  - Other name\n---\nlead\n# One\ntext\n### Deep\nmore\n```\n# no heading\n```\n"
    sections, aliases = markup.note_sections(text)
    assert [(s.heading, s.tags) for s in sections] == [("", ["a", "b"]), ("One", ["a", "b"]), ("One > Deep", ["a", "b"])]
    assert aliases == ["Other name"] and "# no heading" in sections[2].body
    assert markup.note_sections("")[0] == []


def test_split_section():
    text = "\n\n".join(["p" * 400] * 6)
    parts = markup.split_section(text)
    assert len(parts) > 1 and "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert markup.split_section("x" * 5000, 0) == ["x" * 5000] and markup.split_section("  ") == []
    fence = "```\n" + "\n\n".join(["c" * 500] * 5) + "\n```"
    assert markup.split_section(fence) == [fence]


PAGE = """<html><head><title>Page — Tool 1.2 documentation</title></head><body><nav>menu</nav><article><section id=s1><h1>First<a class=headerlink>#</a></h1><p>One<br>two</p>
<section id="s2"><h2>Sub</h2><ul><li>item<li>next</ul><pre>code
  here</pre></section></section></article><footer>end</footer>"""


def test_html():
    s = markup.html_sections(PAGE)
    assert [(x.heading, x.anchor) for x in s] == [("First", "s1"), ("First > Sub", "s2")]
    assert s[0].body == "One two" and s[1].body == "item\n\nnext\n\n```\ncode\n  here\n```"
    assert markup.html_title(PAGE) == "First" and markup.html_title("<title>A :: B</title>") == "B" and markup.html_title("", "f") == "f"
    assert markup.manual_draft(PAGE)["version"] == "1.2"
    assert markup.mostly_links("<a>link text here</a> x")


def test_titles():
    assert markup.choose_title("Microsoft Word - x", ["John Smith", "A Real Title of It"], "scan0001") == "A Real Title of It"
    assert markup.choose_title("", [], "A curated name") == "A curated name"
    assert not markup.plausible_title("s p a c e d out") and not markup.plausible_title("A title with")


def test_epub_and_fb2():
    body = "<p>" + "long text of the chapter " * 12 + "</p>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><metadata><title>T</title><creator role="aut" file-as="Lee, A.">A. Lee</creator><identifier scheme="ISBN">9780306406157</identifier></metadata><manifest><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/t.ncx", '<ncx><navMap><navPoint><navLabel><text>Chapter one</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>')
        z.writestr("o/a.xhtml", f"<html><body><a/>{body}</body></html>")
    s, meta = ebooks.epub(buf.getvalue())
    assert [x.heading for x in s] == ["Chapter one"] and meta == {"title": "T", "authors": ["Lee, A."], "isbn": "9780306406157"}
    fb = f"<?xml version='1.0' encoding='windows-1251'?><FictionBook><description><title-info><author><first-name>Иван</first-name><last-name>Лисов</last-name></author><book-title>Книга</book-title></title-info></description><body><section><title><p>Часть</p></title><section><title><p>Глава</p></title>{body}</section></section></body><body name='notes'>{body}</body></FictionBook>"
    s, meta = ebooks.fb2(fb.encode("cp1251"))
    assert [x.heading for x in s] == ["Часть > Глава"] and meta["authors"] == ["Лисов, Иван"]


def test_mobi():
    text = b"<html><body><h1>Name</h1><p>" + b"words of the book " * 20 + b"</p></body></html>"
    head = bytearray(264)
    struct.pack_into(">HHIH", head, 0, 1, 0, len(text), 1)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 20, 232)
    struct.pack_into(">I", head, 28, 65001)
    struct.pack_into(">I", head, 36, 6)
    pdb = bytearray(78 + 16)
    pdb[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", pdb, 76, 2)
    struct.pack_into(">I", pdb, 78, len(pdb))
    struct.pack_into(">I", pdb, 86, len(pdb) + len(head))
    s, _ = ebooks.mobi(bytes(pdb + head) + text)
    assert [x.heading for x in s] == ["Name"]
    assert ebooks.unpack_palmdoc(b"abc\x80\x18\xf7") == b"abcabc w" or ebooks.unpack_palmdoc(b"\x03xyz") == b"xyz"
    with pytest.raises(ValueError):
        ebooks.mobi(b"\0" * 200)


def test_files(spark, tmp_path):
    from quire.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub" / "Note one.md").write_text("# H\nbody of the note", encoding="utf-8")
    (tmp_path / ".git" / "x.md").write_text("no")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = files.read_chunks(files.walk(spark, f"file://{tmp_path}", "vault")).collect()
    assert [(r.path, r.title, r.heading, r.lang) for r in got] == [("sub/Note one.md", "Note one", "H", "english")]
    assert "Bad" in files.read_chunks(files.walk(spark, f"file://{tmp_path}", "book")).first().error
    records = spark.createDataFrame([("b", "x"), ("a", "y")], "citekey string, csl string")
    out = f"file://{tmp_path}/bib"
    assert files.write_bibliography(records, out) and not files.write_bibliography(records, out)
    assert [r.citekey for r in files.read_bibliography(spark, out, "citekey string, csl string").collect()] == ["a", "b"]


def test_records(spark):
    d = B.draft("book", "[tag] Name of it (site.org)", "Lee, Ann; Roe, Bob", "10.1000/abc123 ISBN 978-0-306-40615-7", "")
    assert d == {"type": "book", "title": "Name of it", "author": [{"family": "Lee", "given": "Ann"}, {"family": "Roe", "given": "Bob"}], "ISBN": "9780306406157", "DOI": "10.1000/abc123"}
    assert B.draft("book", "N", "admin", "10.1000/abc123", "")["type"] == "article-journal"
    assert "ISBN" not in B.draft("paper", "N", "", "ISBN 978-0-306-40615-7", "")
    e = B.biblatex("lee2001", {"type": "chapter", "title": "A & B", "container-title": "C", "author": [{"family": "Lee", "given": "A."}, {"literal": "Org"}], "issued": {"date-parts": [[2001, 3]]}, "language": "ru"})
    assert e == "@incollection{lee2001,\n  author = {Lee, A. and {Org}},\n  title = {A \\& B},\n  booktitle = {C},\n  date = {2001-03},\n  langid = {russian},\n}\n"
    row = B.csl_json(spark.createDataFrame([('k"1', '{"type":"book"}'), ("e", "{}")], "citekey string, csl string")).collect()
    assert [json.loads(r.csl) for r in row] == [{"id": 'k"1', "type": "book"}, {"id": "e"}]
    info = B.style_info('<style xmlns="x"><info><id>http://z/styles/gost</id><title>G</title><link rel="independent-parent" href="http://z/styles/apa"/></info></style>')
    assert info == {"id": "gost", "title": "G", "parent": "apa"} and B.style_slug("http://z/../..") == ""


def test_significance():
    assert E.sign_test(0, 0) == 1 and E.sign_test(5, 5) == 1
    assert E.sign_test(10, 0) == pytest.approx(2 / 1024)
    assert E.randomization_test([]) == 1 and E.randomization_test([1.0] * 5) == pytest.approx(2 / 32)
    d = [0.3, -0.1, 0.2, 0.5, -0.2, 0.1, 0.4]
    whole = E.randomization_test(d)
    assert abs(E.randomization_test(d * 3, 20_000) - E.randomization_test(d * 3, 20_000, seed=2)) < 0.02 and 0 < whole < 1


def test_comparison_of_many_queries(spark):
    n, more = 200_000, 600
    q = spark.range(n).withColumnRenamed("id", "query_id")
    a, b = q.withColumn("rr", F.lit(0.5)), q.withColumn("rr", F.when(F.col("query_id") < (n + more) // 2, 1.0).otherwise(0.0))
    tracemalloc.start()
    try:
        got, peak = E.compare(a, b), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got["wins"], got["losses"], got["ties"], got["delta"]) == (100_300, 99_700, 0, 0.5 * more / n)
    assert got["p_random"] == pytest.approx(math.erfc(more / math.sqrt(2 * n)), abs=0.01)
    assert peak < 100e6  # not a number for every query and draw


def test_relevance_and_pairs(spark):
    from pyspark.sql import functions as F

    judged = spark.createDataFrame([("n.md", 0, "A > B", [("", [], "n.md", "B")]), ("n.md", 0, "A", [("", [], "n.md", "B")]), ("x/Book.pdf", 3, "", [("book", [3, 4], "", "")]), ("x/Book.pdf", 9, "", [("book", [3], "", "")])], "p string, g int, s string, j array<struct<path:string,pages:array<int>,note:string,section:string>>")
    assert [r.x for r in judged.select(E.relevant(F.col("p"), F.col("g"), F.col("s"), F.col("j")).alias("x")).collect()] == [True, False, True, False]
    notes = spark.createDataFrame([("a.md", "A", ["Alpha"], "see [[B|the bee]] and [[B#S|part]] and [[Gone|x]]"), ("b.md", "B", ["b"], "[[A|the bee]]")], "path string, name string, aliases array<string>, body string")
    got = {(r.query, r.note, r.section, r.source) for r in E.mine_pairs(notes).collect()}
    assert got == {("Alpha", "a.md", "", "alias"), ("part", "b.md", "S", "section")}


def values(spark, *fields):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "id long, s string")
    out: dict[int, list[str]] = {}
    for r in M.explode_values(df, ["id"], "s").orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append(r.val)
    return out


def test_values(spark):
    got = values(
        spark, 'Ivanov, I. I.; Petrov, P.', 'Ann Lee, Bob Roe and Cy Poe', '"Lee, Ann", "Roe, Bob"', "A. Lee / B. Roe|C. Poe", "Лисов, И. и др.", None, "  ;; ", "Lee, A., Jr.; Roe, B.",
        "“Institute of Slow Things, Field Office”; A. Lee", "Institute of Slow Things, Field Office", "Lee, A.\nRoe, B.", "Lee, Ann", 'Lee, Ann; Lee, Ann; ; ', '"unclosed Lee; B. Roe',
    )
    assert got == {
        0: ["Ivanov, I. I.", "Petrov, P."], 1: ["Ann Lee", "Bob Roe", "Cy Poe"], 2: ["Lee, Ann", "Roe, Bob"], 3: ["A. Lee", "B. Roe", "C. Poe"], 4: ["Лисов, И."], 7: ["Lee, A., Jr.", "Roe, B."],
        8: ["Institute of Slow Things, Field Office", "A. Lee"], 9: ["Institute of Slow Things, Field Office"], 10: ["Lee, A.", "Roe, B."], 11: ["Lee, Ann"], 12: ["Lee, Ann", "Lee, Ann"], 13: ["unclosed Lee", "B. Roe"],
    }


def test_values_odd_tables(spark):
    assert values(spark, "") == {}
    empty = spark.createDataFrame([], "id long, s string, val string, pos int")
    assert M.explode_values(empty, ["id"], "s").count() == 0
    clash = spark.createDataFrame([(1, "A. Lee; B. Roe", "x", 9)] * 3, "id long, s string, val string, pos int")
    assert [(r.pos, r.val) for r in M.explode_values(clash, ["id"], "s").orderBy("pos").collect()] == [(1, "A. Lee"), (2, "B. Roe")]
    long = "; ".join(f"A. Lee{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    assert len(values(spark, long)[0]) == 500


def test_salted_ranks(spark):
    from quire.runtime import salted_row_number

    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN 'hot' ELSE 'cold' END AS k")
    got = salted_row_number(df, ["k"], ["id"], "rn").groupBy("k").agg({"rn": "max"}).collect()
    assert {r[0]: r[1] for r in got} == {"hot": 900, "cold": 100}
    assert salted_row_number(df, ["k"], ["id"], "rn").select("k", "rn").distinct().count() == 1000


def test_column_of_wares_needs_no_names(spark):
    """Wares, some with an inner comma that no delimiter ever settles: only what recurs as a whole tells them from two."""
    rnd = random.Random(4)
    plain = "oak pine resin wax copper linen chalk amber felt cork slate hemp wool zinc".split()
    inner = ["salt, sea", "cheese, mild", "paper, ruled", "thread, waxed", "oil, raw"]
    settled = ['"glue, thick"; cork', '"cloth, fine"; wool', '"paint, dry"; "soap, soft"', "resin | oak", '"ink, blue" | zinc', '"rope, long"; "wire, thin"']
    fields, want = list(settled), {}
    for _ in range(150):
        items = rnd.sample(plain, 3) + rnd.sample(inner, 1)
        rnd.shuffle(items)
        fields.append(", ".join(items))
        want[fields[-1]] = items
    df = spark.createDataFrame([(x,) for x in fields], "s string")

    def found(rounds):
        got = {}
        for r in M.split_values(df, rounds).orderBy("s", "pos").collect():
            got.setdefault(r.s, []).append(r.val)
        return {k: got[k] for k in want}

    right = lambda got: sum(got[k] == v for k, v in want.items()) / len(want)
    assert right(found(3)) > 0.85
    assert right(found(0)) < 0.35  # without expectation-maximisation


def test_long_values_and_many_cells():
    whole = "Board of " + ", ".join(f"Ward {i}" for i in range(30))
    m, edges = M.lattice(f"A. Lee; {whole}; B. Roe")
    assert m == 32 and whole in {e[2] for e in edges} and len(edges) < 32 * (M.RUN + 1)
    assert M.lattice("")[0] == 0 and M.lattice(" ;, ; ")[0] == 0
