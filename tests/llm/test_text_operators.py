"""Problems 2, 3, 5, 7 and 10 on small and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import boilerplate as L
from quire.llm import lookalikes as K
from quire.llm import ppm
from quire.llm import scans as S
from quire.llm import splitting as X

# ---- 5


def lines_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, site string, body string, lines string, key int, docs int")


def test_recurring_lines_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, f"s{i % 2}", "\n".join(rnd.choice(["Share it!", "share  IT", "Page 3 of 9", f"own text {i} {c}", "", "12"]) for c in "abcd"), "x", 1, 2) for i in range(40)]
    rows += rows[:5] + [(None, "s0", "Share it!", "", 0, 0), (90, None, "Share it!", "", 0, 0), (91, "s0", None, "", 0, 0), (92, "s0", "", "", 0, 0)]
    lines = L.keyed_lines(lines_table(spark, rows))
    got = {(r.doc_id, r.line_no) for r in L.repeated_lines(lines, L.recurring(L.count_delta(lines))).collect()}
    docs = {i: (s, b) for i, s, b, *_ in rows if i is not None and s is not None and b is not None}
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    want = set()
    for i, (s, b) in docs.items():
        for n, line in enumerate(b.split("\n"), 1):
            own = [x for x, (t, y) in docs.items() if t == s]
            hit = sum(key(line) in map(key, docs[x][1].split("\n")) for x in own)
            if key(line) and hit >= 5 and hit * 100 >= 15 * len(own):
                want.add((i, n))
    assert got == want and want
    built = {r.doc_id: r.body for r in L.rebuild(lines_table(spark, rows), spark.createDataFrame(sorted(want), "doc_id long, line_no int")).collect()}
    assert built == {i: "\n".join(x for n, x in enumerate(docs[i][1].split("\n"), 1) if (i, n) not in want) for i in {i for i, _ in want}}


def test_increments_equal_the_whole(spark):
    rows = [(i, "s", f"common\nline {chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 3 else "other", "", 0, 0) for i in range(30)]
    table = lines_table(spark, rows)
    one, two = L.fold([L.keyed_lines(table.where("doc_id < 6")), L.keyed_lines(table.where("doc_id >= 6"))])
    (whole,) = L.fold([L.keyed_lines(table)])
    assert {tuple(r) for r in two.state.repeated.collect()} == {tuple(r) for r in whole.state.repeated.collect()}
    assert {tuple(r) for r in two.state.found.collect()} == {tuple(r) for r in whole.state.found.collect()}
    assert one.state.repeated.count() == 0 and two.crossed.count() == 2
    assert {r.doc_id for r in two.rebuild.collect()} == set(range(30))


def test_only_touched_documents_are_rebuilt(spark):
    """A line begins to recur, another ceases as the site grows, a third stays; documents come again in later partitions."""
    text = lambda i: "\n".join(["stays", *(["early"] if i < 5 else []), *(["late"] if i >= 18 else []), f"own {chr(97 + i % 26)}{chr(97 + i // 26)}"])
    rows = [(i, "s", text(i), "", 0, 0) for i in range(60)] + [(200, "t", "stays", "", 0, 0)]
    table = lines_table(spark, rows)
    parts = [table.where("doc_id < 20"), table.where("doc_id BETWEEN 10 AND 49 OR doc_id = 200"), table.where("doc_id >= 40 OR doc_id < 3")]
    steps = list(L.fold(L.keyed_lines(x) for x in parts))
    (whole,) = L.fold([L.keyed_lines(table)])
    assert [tuple(sorted(r.docs for r in s.state.sizes.withColumnRenamed("total", "docs").collect())) for s in steps] == [(20,), (1, 50), (1, 60)]
    assert {tuple(r) for r in steps[2].state.found.collect()} == {tuple(r) for r in whole.state.found.collect()}
    assert {r.doc_id for r in steps[1].rebuild.collect()} == {*range(5), *range(18, 50)}  # early ceased, late began, and the new ones
    assert {r.doc_id for r in steps[2].rebuild.collect()} == set(range(50, 60))
    built = {r.doc_id: r.body for r in L.rebuilt_bodies(table, steps).collect()}
    assert built == {i: "\n".join(x for x in text(i).split("\n") if x not in ("stays", "late")) for i in range(60)}


def test_no_documents(spark):
    lines = L.keyed_lines(lines_table(spark, []))
    steps = list(L.fold([lines, lines]))
    assert steps[-1].state.found.count() == 0 and L.rebuilt_bodies(lines_table(spark, []), steps).count() == 0


# ---- 7


@pytest.mark.parametrize("text", ["", "   ", "short", "w" * 5000, "word " * 2000, ("Sentence one here. " * 30 + "\n\n") * 10, "# H\n" + "text " * 200 + "\n# I\n" + "text " * 300, "é" * 700, "```\n" + "code();\n" * 400 + "```"])
@pytest.mark.parametrize(("limit", "overlap", "target"), [(600, 50, 400), (100, 0, 0), (64, 64, 10), (1, 0, 0), (600, 599, 0)])
def test_pieces(text, limit, overlap, target):
    got = X.pieces(text, limit, overlap, target)
    bare = text.strip()
    over = limit // 2 if overlap >= limit else overlap
    assert all(0 < len(p) <= limit for *_, p in got)
    assert [p[0] for p in got] == list(range(1, len(got) + 1))
    rebuilt = ""
    for n, start, stop, p in got:
        assert bare[start:stop] == p
        assert n == 1 or start == max(0, len(rebuilt) - over)  # the overlap is exact
        rebuilt = rebuilt[:start] + p
    assert rebuilt == bare
    assert len(got) <= 1 or len(bare) > limit


def test_cuts_are_natural():
    text = "\n\n".join(["A sentence here. Another one there. " * 4] * 12)
    starts = [text.strip()[a:][:1] for _, a, _, _ in X.pieces(text, 700, 0, 500)]
    assert set(starts) == {"A"}
    assert X.pieces(None, 5, 1) == [] and X.pieces("x y", None, None) == [(1, 0, 3, "x y")] and X.pieces("long text", 0, 3) == [(1, 0, 9, "long text")]


def test_split_table(spark):
    rows = [(1, " " + "word " * 100, 100, 10, 50, "z"), (1, " " + "word " * 100, 100, 10, 50, "z"), (2, "few", 100, 10, 50, "z"), (3, None, 100, 1, 1, "z"), (4, " \n ", 100, 1, 1, "z"), (5, "x" * 200, None, None, None, "z"), (None, "x" * 200, 10, 1, 1, "z")]
    df = spark.createDataFrame(rows, "item_id long, text string, above int, overlap int, target int, piece string")
    got = X.split_items(df).collect()
    assert {r.item_id: max(x.piece for x in got if x.item_id == r.item_id) for r in got} == {1: len(X.pieces(rows[0][1], 100, 10, 50)), 2: 1, 5: 1}
    assert len(got) == len({(r.item_id, r.piece) for r in got})
    assert X.split_items(df.where("false")).count() == 0


# ---- 10


def test_canonical_forms():
    same = ["Ｆｕｌｌ ｗｉｄｔｈ １", "Full width 1", "Fu​ll width﻿ 1", "F­ull width 1", "Full width 1"]
    assert len({K.canonical(x) for x in same}) == 1
    assert K.canonical("Сор") == K.canonical("Cop")  # no telling letter: one script for all
    assert K.canonical("Привет мир, cосна") == "Привет мир, сосна" and K.canonical("plаin words") == "plain words"
    assert K.canonical("ёлка и й") == K.canonical("ёлка и й") == "ёлка и й"
    assert K.canonical("À l’heure") == K.canonical("А̀ l’heure")
    for x in ("x²", "①", "𝐱", "ﬁ x2"):
        assert K.canonical(x) == x.replace("ﬁ", "fi")
    assert K.canonical(None) is None and K.canonical("") == "" and K.canonical("Line\nTwo") == "Line\nTwo"
    assert K.canonical("नमस्‍ते") == "नमस्‍ते" and K.canonical("한글") == K.canonical("한글")


def test_canonical_is_stable():
    rnd = random.Random(2)
    letters = "abcаосxyZпривет éё́‍ Ｗ１ﬁ̈ΑΒο-‐\n"
    for _ in range(2000):
        c = K.canonical("".join(rnd.choice(letters) for _ in range(rnd.randrange(40))))
        assert K.canonical(c) == c


def test_long_text_is_canonical_at_its_end():
    assert K.canonical("я " * 200_000 + "cосна") == "я " * 200_000 + "сосна"


def test_pairs_by_look(spark):
    rows = [(1, "Full text"), (2, "Full text"), (3, "Full text"), (4, "other"), (5, None), (6, ""), (7, ""), (2, "Full text"), (8, "Ｆull text"), (None, "Full  text")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, look int, raw string")
    assert sorted(map(tuple, K.alike_pairs(K.looks(df)).collect())) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert K.alike_pairs(K.looks(df.where("false"))).count() == 0
    assert {r.doc_id: r.text for r in K.canonical_texts(df).where("doc_id IN (5, 6, 8)").collect()} == {5: None, 6: "", 8: "Full text"}


# ---- 3

TEXTS = {
    "english": "The first windows rebuild nothing, since the cursor was never ordered enough. Later chapters return to shared pages once more. ",
    "russian": "Мы видели, что общие очереди редко заменяют друг друга при большом числе журналов. Так появились новые потоки и целые наборы сводок. ",
    "german": "Deshalb verwerfen diese Schlüssel mindestens einige Zeiger in jedem Durchlauf. Man erkennt außerdem, dass die Ströme sich wiederholen. ",
    "french": "Les jetons partagés remplacent les segments, même si les lecteurs ne changent pas. Nous reviendrons plus tard aux registres étroits. ",
    "spanish": "También se observa que los testigos y los índices no repiten los mismos márgenes. Quien compare los fragmentos hallará diferencias. ",
    "ukrainian": "Тому сторінки і розділи завжди порівнюють щонайменше кілька черг за один прохід. Хто порівняє вектори, знайде не більш як десять відмінностей. ",
}


@pytest.fixture(scope="module")
def trees():
    return ppm.train([(k, v * 3) for k, v in TEXTS.items()] * 4 + [("german", TEXTS["english"])])


def test_code_lengths_equal_a_plain_tree():
    data = {"english": b"abracadabra abra", "russian": b"banana band"}
    t = ppm.Trees(data, 2)

    def plain(text: bytes, sample: bytes) -> float:
        total = 0.0
        for i in range(len(text)):
            for k in range(2, -1, -1):
                if i < k:
                    continue
                ctx = text[i - k : i]
                after = [sample[j + k] for j in range(len(sample) - k) if sample[j : j + k] == ctx]
                if not after:
                    continue
                n, distinct = len(after), len(set(after))
                hit = after.count(text[i])
                total += __import__("math").log2((n + distinct) / (hit or distinct))
                if hit:
                    break
            else:
                total += 8
        return total

    import numpy as np

    text = b"abra banana xyz"
    got = t.code_lengths(np.frombuffer(text, dtype=np.uint8), np.array([0]))[0]
    for lang, sample in data.items():
        assert got[ppm.LANGUAGES.index(lang)] == pytest.approx(plain(text, sample), abs=0.3)


def test_segments(trees):
    for k, v in TEXTS.items():
        assert [s[1] for s in ppm.segments(trees, [v])[0]] == [k]
    mixed = TEXTS["english"] + "\n\n" + TEXTS["german"] + TEXTS["russian"]
    got = ppm.segments(trees, [mixed, None, "", " 12 34 -- ", "x"])
    assert [s[1] for s in got[0]] == ["english", "german", "russian"] and got[1] == got[2] == got[3] == []
    assert "".join(mixed[s[3] : s[4]] for s in got[0]) == mixed and mixed[got[0][1][3] :].startswith("Deshalb")
    assert len(ppm.segments(trees, [TEXTS["french"] * 2000])[0]) == 1


def test_labels(spark, trees):
    rows = [(1, "EN", TEXTS["english"]), (2, "deu", TEXTS["russian"]), (3, "simple", TEXTS["german"]), (4, "Russian", TEXTS["russian"] + TEXTS["french"]), (5, None, None), (6, "en", ""), (1, "EN", TEXTS["english"]), (None, "en", TEXTS["english"])]
    df = spark.createDataFrame([(i, x, b, 3, "q") for i, x, b in rows], "item_id long, lang string, body string, seg int, label string")
    found = ppm.identify(df, trees)
    assert found.count() == 5
    assert sorted((r.item_id, r.seg, r.lang) for r in ppm.mislabelled(found).collect()) == [(2, 1, "russian"), (3, 1, "german"), (4, 1, "russian"), (4, 2, "french")]
    assert ppm.identify(df.where("false"), trees).count() == 0
    assert ppm.training_rows([df.where("false")]) == []
    assert ppm.segments(ppm.train([]), ["some text. more text."])[0][0][0] == 1


# ---- 2


def test_glyph_edits():
    assert all(S.plausible(a, b) for a, b in [("before", "beforc"), ("counters", "c0urifers"), ("journals", "joumals"), ("pipeline", "pipehne"), ("cluster", "duster"), ("которые", "к0торьlе")])
    assert not S.plausible("before", "before") and not S.plausible("again", "against") and not S.plausible("", "x")
    for a, b in [("before", "beforc"), ("kernel", "kerriel"), ("cyclic", "cychc"), ("outline", "out1ine"), ("раньше", "раньniе")]:
        assert S.skeletons(a) & S.skeletons(b)


@pytest.fixture(scope="module")
def scanned(spark):
    words = "the ordered ledger keeps a shared window before every reader returns".split()
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        text = [" ".join(rnd.sample(words, 8)).capitalize() + "." for _ in range(6)]
        rows.append((i, i % 4, "\n".join(text)))
    rows[0] = (0, 0, "Quiet Rivers of the North\n" + rows[0][2] + "\nThe ordered led-\nger keeps a shared window beforc every reader returns.\n17")
    rows[1] = (1, 1, "3. A chapter of it\n" + rows[1][2])
    rows[5] = (5, 1, "3. A chapter of it   |   l2\n" + rows[5][2])
    rows[2] = (2, 2, rows[2][2] + "\nA cost-based win¬\ndow.")
    rows += [(900, 1, None), (901, 1, "  "), (902, None, rows[3][2]), (None, 1, "x"), rows[0]]
    pages = spark.createDataFrame([(i, s, b, "q", 1) for i, s, b in rows], "item_id long, source_id long, body string, title string, damage int")
    sources = spark.createDataFrame([(0, "book", "Quiet rivers of the north: a report"), (1, "paper", None), (2, "paper", ""), (3, "book", "Else")], "source_id long, kind string, title string")
    return pages.select("item_id", "source_id", "body"), sources


def test_damage(scanned):
    got = sorted(map(tuple, S.damage(*scanned).collect()))
    assert got == [(0, "folio"), (0, "header"), (0, "hyphen"), (0, "misread"), (1, "header"), (2, "hyphen"), (5, "folio"), (5, "header"), (5, "misread")]


def test_clean(scanned):
    got = {r.item_id: r.text for r in S.clean(*scanned).collect()}
    assert got[0].endswith("ledger keeps a shared window before every reader returns.") and "Quiet" not in got[0] and "\n" not in got[0]
    assert got[2].endswith("A cost-based window.") and got[900] == "" and got[901] == ""


@pytest.fixture(scope="module")
def topics(spark):
    """Two topics. c1am may be clam (kitchen) or ciam (sea); cask is a real word of the sea, one glyph from the kitchen's eask."""
    kitchen = "stove butter onion garlic simmer spoon recipe flour pepper oven clam eask boil sauce".split()
    sea = "anchor harbour sailor mast keel compass tide rudder deck captain ciam voyage storm rope".split()
    rnd = random.Random(8)
    page = lambda words, more=(): "\n".join(" ".join(rnd.choices(words, k=9)) + "." for _ in range(8)) + "".join(f"\n{x}." for x in more)
    rows = [(i, i % 3, page(kitchen if i % 2 else sea)) for i in range(200)]
    rows += [(1000, 0, page(kitchen, ["stove butter onion c1am garlic simmer spoon"])), (1001, 0, page(sea, ["anchor harbour sailor c1am mast keel compass"]))]
    rows += [(1002 + i, 1, page(sea, ["sailor tide rudder cask deck captain rope"])) for i in range(4)]
    rows += [(1010, 2, page(kitchen, ["oven sauce boil stoue pepper", "onion garlic peppcr flour recipe"]))]
    sources = spark.createDataFrame([(i, "book", None) for i in range(3)], "source_id long, kind string, title string")
    return spark.createDataFrame(rows, "item_id long, source_id long, body string"), sources


def repaired(topics):
    texts = {r.item_id: r.text for r in S.clean(*topics).where("item_id >= 1000").collect()}
    return {
        "kitchen": "onion clam garlic" in texts[1000], "sea": "sailor ciam mast" in texts[1001], "rare": all("rudder cask deck" in texts[1002 + i] for i in range(4)),
        "one": "garlic pepper flour" in texts[1010], "none": "stoue" in texts[1010],
    }


def test_vectors_decide(topics, monkeypatch):
    assert repaired(topics) == dict.fromkeys(["kitchen", "sea", "rare", "one", "none"], True)
    assert S.damage(*topics).where("item_id >= 1000 AND damage = 'misread'").count() == 3
    monkeypatch.setattr(S, "NEIGHBOUR", -2.0)  # every possible link, judged in its place alone
    assert repaired(topics) == dict.fromkeys(["kitchen", "sea", "rare", "one", "none"], True)
    monkeypatch.setattr(S, "FIT", -99.0)  # the glyphs alone
    assert not repaired(topics)["rare"]


def test_no_vectors_no_corrections(topics, monkeypatch):
    place = S._place
    monkeypatch.setattr(S, "_place", lambda v, noise: place(v * 0, noise))
    assert S.damage(*topics).where("item_id >= 1000 AND damage = 'misread'").count() == 0


def test_pages_take_their_own_part_of_what_was_learned(topics, scanned, monkeypatch):
    broad = [sorted(map(tuple, S.damage(*x).collect())) for x in (topics, scanned)]
    monkeypatch.setattr(S, "SHARED_BYTES", 0)
    assert [sorted(map(tuple, S.damage(*x).collect())) for x in (topics, scanned)] == broad


def test_compounds_keep_their_hyphen(spark):
    rows = [(i, 0, "a cost-based window opens here.\nanother ledger closes there.") for i in range(30)] + [(100, 0, "It is a cost-\nbased window of the led-\nger here.")]
    pages = spark.createDataFrame(rows, "item_id long, source_id long, body string")
    sources = spark.createDataFrame([(0, "book", None)], "source_id long, kind string, title string")
    got = S.clean(pages, sources).where("item_id = 100").first()
    assert got.text == "It is a cost-based window of the ledger here." and got.damage == ["hyphen"]


def test_no_pages(spark, scanned):
    pages, sources = scanned
    assert S.damage(pages.where("false"), sources).count() == 0


def test_reflow():
    assert S.reflow("One line\nruns on.\n\nNew one.\n1 2 3\n4 5 6") == "One line runs on.\n\nNew one.\n\n1 2 3\n\n4 5 6"
    assert S.reflow("broken\n\nsentence goes on.") == "broken sentence goes on."
    lex = S.Lexicon({}, S.np.zeros((1, 2)), {}, {"well-known"})
    assert S.repair("a well-\nknown thing.", None, set(), lex, True) == ([], "a well-known thing.")
    assert S.repair("so much well-\nness.", None, set(), lex)[0] == ["hyphen"]


def test_phrases_and_code_make_no_segment(trees):
    for extra in ("«Les jetons partagés».", "[Мы видели, что]", '("Man erkennt außerdem").', "```\nfor item in shelf:\n    yield item\n```"):
        for body in (TEXTS["english"] + extra, extra + " " + TEXTS["english"], TEXTS["english"] + extra + "\n" + TEXTS["english"]):
            assert [s[1] for s in ppm.segments(trees, [body])[0]] == ["english"]
    code = TEXTS["english"] + "```\n" + "x = 1\n" * 20 + "```\n" + TEXTS["german"]
    got = ppm.segments(trees, [code])[0]
    assert [s[1] for s in got] == ["english", "german"] and code[got[1][3] :].startswith("Deshalb")
    assert ppm.segments(trees, [TEXTS["russian"].upper()])[0][0][1] == "russian"
