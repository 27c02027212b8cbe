"""Problems 1, 6, 8 and 9 on small and odd inputs."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import runtime as R
from quire.llm import matching as M
from quire.llm import mixing as X
from quire.llm import neighbours as N
from quire.llm import packing as P
from quire.llm import tokens as T

# ---- 6


def brute(ids, m, k):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -sims[r].round(12)))[:k]] for r, i in enumerate(ids)}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    which = rng.choice(6, 1500, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
    m = (centres[which] + rng.normal(scale=0.4, size=(1500, 16))).astype(np.float32)
    rows = [(i, m[i].tolist(), "x", i) for i in range(1500)]
    return np.arange(1500), m.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, near string, id int")


def test_recall_against_brute_force(spark, cloud):
    ids, m, df = cloud
    pts = N.points(df).cache()
    near = N.graph(pts)
    got = {}
    for r in N.nearest(pts, N.scored(pts, near), N.members(df)).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    want = brute(ids, m, 10)
    assert set(map(len, got.values())) == {10}
    assert np.mean([len(got[i] & set(w)) / 10 for i, w in want.items()]) > 0.98
    asked = pts.where("id % 50 = 0").select(F.col("id").alias("query_id"), "e")
    hits = {}
    for r in N.search(pts, near, asked).collect():
        hits.setdefault(r.query_id, set()).add(r.id)
    assert np.mean([len(hits[i] & {i, *want[i][:9]}) / 10 for i in hits]) > 0.9


def test_recall_over_many_blocks(spark, cloud):
    ids, m, df = cloud
    pts = N.points(df).cache()
    assert N.start(pts, block=60)[0].select("block").distinct().count() > 15
    want = brute(ids, m, 10)
    got = {r.id: {x.id for x in r.near[:10]} for r in N.graph(pts, block=60).collect()}
    assert np.mean([len(got[i] & set(w)) / 10 for i, w in want.items()]) > 0.98


def test_rounds_walk_every_kept_entry(spark):
    angles = [0.0, *(0.1 + 0.01 * i for i in range(1, N.WIDTH + 1)), 0.01]
    pts = spark.createDataFrame([(i, bytearray(np.array([np.cos(a), np.sin(a)], dtype=np.float16).tobytes())) for i, a in enumerate(angles)], "id long, v binary")
    home = pts.select("id", F.lit(0).cast("long").alias("block"))
    lists = [(0, [(float(np.cos(angles[i])), i, True) for i in range(1, N.WIDTH + 1)]), (15, [(0.99, N.WIDTH + 1, True)])]
    near = spark.createDataFrame(lists + [(i, []) for i in range(1, N.WIDTH + 2) if i != 15], "id long, near array<struct<sim:float,id:long,new:boolean>>")
    got = N.descend(pts, home, near).where("id = 0").first()
    assert got.near[0].id == N.WIDTH + 1  # reached from the fifteenth entry alone


def test_a_round_brings_together_all_beside_a_point(spark):
    at = {0: 0.0, 1: 0.001, 2: 0.9, 40: 1.0, 41: 1.001} | {i: 0.1 + 0.001 * i for i in range(3, 33)}
    pts = spark.createDataFrame([(i, bytearray(np.array([np.cos(a), np.sin(a)], dtype=np.float16).tobytes())) for i, a in at.items()], "id long, v binary")
    lists = {2: [0, 1], 40: [0], 0: [41]} | {i: [0] for i in range(3, 33)}  # more list 0 than it meets as its best reverse ones
    near = spark.createDataFrame([(i, [(float(np.cos(at[i] - at[j])), j, True) for j in lists.get(i, [])]) for i in at], "id long, near array<struct<sim:float,id:long,new:boolean>>")
    got = {r.id: {x.id for x in r.near} for r in N.descend(pts, pts.select("id", F.lit(0).cast("long").alias("block")), near).collect()}
    assert 1 in got[0] and 0 in got[1]  # both listed by 2, the least similar of those that list 0
    assert 41 in got[40]  # listed by 0, which 40 lists


def test_search_goes_on_until_all_is_expanded(spark, monkeypatch):
    angles = np.linspace(0, 2.8, 240)  # a chain: only the walk along it leads from the entry to the query
    e = [np.array([np.cos(a), np.sin(a)]) for a in angles]
    pts = spark.createDataFrame([(i, bytearray(x.astype(np.float16).tobytes()), bytearray(x.tobytes())) for i, x in enumerate(e)], "id long, v binary, e binary")
    near = spark.createDataFrame([(i, [(float(e[i] @ e[j]), j, False) for j in (i - 1, i + 1) if 0 <= j < 240]) for i in range(240)], "id long, near array<struct<sim:float,id:long,new:boolean>>")
    first = pts.orderBy(F.xxhash64("id")).first().id
    monkeypatch.setattr(N, "ENTRIES", 1)
    monkeypatch.setattr(N, "BLOCK_ENTRIES", 0, raising=False)
    goal = first + 20 if first < 120 else first - 20
    asked = pts.where(F.col("id") == goal).select(F.lit(7).cast("long").alias("query_id"), "e")
    assert N.search(pts, near, asked, k=1, beam=4).first().id == goal


def test_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(30)] + [(100, [2.0, 4.0, 6.1]), (101, [-1.0, 0.0, 0.5]), (102, None), (103, [0.0, 0.0, 0.0]), (104, [1.0, None, 2.0]), (105, [1.0, 2.0]), (106, [float("nan"), 1.0, 1.0]), (100, [2.0, 4.0, 6.1]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pts = N.points(df).cache()
    assert sorted((r.id, r.n) for r in pts.collect()) == [(0, 30), (100, 1), (101, 1)]
    got = {}
    for r in N.nearest(pts, N.scored(pts, N.graph(pts)), N.members(df)).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got[0] == list(range(1, 11)) and got[5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and got[100] == list(range(10))
    assert len(got) == 32


def test_rounds_leave_only_the_graph(spark, monkeypatch):
    """Of what the rounds write and shuffle only the lists of the last and the blocks are left."""
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    pts = N.points(df).cache()
    work = Path(re.sub("^file:/+", "/", R._work(spark)))
    tables = lambda: {x.name for x in work.iterdir()} if work.exists() else set()
    shuffled = lambda: {f.name for f in Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()).rglob("shuffle_*.data")}
    pts.count()
    before, files = tables(), shuffled()
    monkeypatch.setattr(N, "PART_POINTS", 30)
    near = N.graph(pts, block=60)
    assert {x.partition("-")[0] for x in tables() - before} == {"home", "found"} and len(tables() - before) == 1 + N.PARTS
    assert near.count() == 300
    home, first = (R.materialise(x) for x in N.start(pts, 60))
    rounds = [{r.id: [(x.id, x.new) for x in r.near] for r in N.descend(pts, home, first, parts).collect()} for parts in (1, 3)]
    assert rounds[0] == rounds[1]  # parts only order the work
    out = R.materialise(spark.range(100).repartition(3, "id"))
    assert out.count() == 100 and spark.conf.get(R.SHUFFLE_CLEANUP, None) is None
    kept = shuffled() - files
    R.materialise(spark.range(100).repartition(5, "id"))
    assert shuffled() - files <= kept  # what is shuffled for a table goes with it


def test_few_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pts = N.points(df)
    assert N.nearest(pts, N.scored(pts, N.graph(pts)), N.members(df)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    pts = N.points(one)
    assert N.nearest(pts, N.scored(pts, N.graph(pts)), N.members(one)).count() == 0


# ---- 1


def test_two_typos_leave_a_key(spark, monkeypatch):
    schema = "id long, title string, persons string, issued string"
    files = spark.createDataFrame([(1, "Dense schemas opaque partitions remote", "Ana Morozova", "2001"), (2, "Quiet ledgers amber harbours broken valleys distant orchards", None, None)], schema)
    cited = spark.createDataFrame([(11, "Dense schemas opaqeu partitions remoet", None, None), (12, "Quiet ledgers abmer harbours borken vallyes distant orchards", None, None)], schema)
    a, b = M.records(files, spread=1)[0].cache(), M.records(cited)[0].cache()
    pairs = lambda: {(r.a, r.b) for r in M.candidates(a, b).where("kind = 'across'").collect()}
    assert {(1, 11), (2, 12)} <= pairs()
    monkeypatch.setattr(M, "KEY_PAIRS", 0)  # every wide key split: a further word anywhere is enough
    assert (2, 12) in pairs()


def test_no_pair_of_a_frequent_key_is_left_out(spark, works, monkeypatch):
    schema = "id long, title string, persons string, issued string"
    files = spark.createDataFrame([(i, f"Amber ledgers remote{x}", None, None) for i, x in enumerate(["", " harbours", " valleys", ": orchards"])], schema)
    cited = spark.createDataFrame([(10 + i, f"Amber ledgers remote{x}", None, None) for i, x in enumerate([" towns", "", " bridges of glass"])], schema)
    every = {("across", a, b) for a in range(4) for b in range(10, 13)} | {("within", a, b) for b in range(4) for a in range(b)}

    def pairs(files, cited):
        got = [tuple(r) for r in M.candidates(M.records(files, spread=1)[0], M.records(cited)[0]).collect()]
        assert len(got) == len(set(got))
        return set(got)

    usual = pairs(*works[:2])
    for bound in (1000, 4, 0):
        monkeypatch.setattr(M, "KEY_PAIRS", bound)  # however few may share a key before it is split
        assert pairs(files, cited) == every
    assert pairs(*works[:2]) == usual


def test_title_left_in_a_printed_entry(spark):
    rows = [
        ("[8] Paula Kornaisted, Milo Drenusted. LAYERED FRAGMENTS IN STATIONS. Journal of Quiet Computing, 2018. doi:10.70577/e98606", "Paula Kornaisted, Milo Drenusted", "Journal of Quiet Computing"),
        ("18. A. Quoreirell (2024). Durable Probes and Footnotes. Trudy Instituta.", "A. Quoreirell", None),
        ("(17) R. P. Quorinsen. COMPACT FRAGMENTS: LESSONS FROM ARCHIVES // Lowland Press. — 2020.", "R. P. Quorinsen", None),
        ("J. Doe. “Quoted ledgers of towns,” Press, 2001.", None, None),
        ("Durable Probes and Footnotes", None, None),
    ]
    df = spark.createDataFrame(rows, "raw string, authors string, container string")
    got = [r[0] for r in df.select(M.printed_title(F.col("raw"), F.col("authors"), F.col("container"))).collect()]
    assert got == ["LAYERED FRAGMENTS IN STATIONS", "Durable Probes and Footnotes", "COMPACT FRAGMENTS: LESSONS FROM ARCHIVES", "Quoted ledgers of towns", None]


# ---- 8


@pytest.mark.parametrize("seed", range(5))
def test_plans_use_everything(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 7, 64, 512])
    counts = {n: rnd.randrange(1, 50) for n in rnd.sample(range(1, capacity + 1), min(capacity, 40))}
    used: dict[int, int] = {}
    full = 0
    for taken, times in P.plan(counts, capacity):
        assert sum(taken) <= capacity and times > 0
        full += times
        for x in taken:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert full <= max(-(-total // capacity) * 1.25 + 1, sum(v for k, v in counts.items() if k * 2 > capacity) + 1)


def test_packing(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([5, 5, 5, 30, 64, 100, 300, 0])) for i in range(2000)] + [(1, 5), (5000, None)]
    rows = [(i, rows[i][1] if i < 2000 else n) for i, n in rows]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("length", F.lit(-1))
    got = P.pack(df, 100).collect()
    room, parts = {}, {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.length
        parts.setdefault(r.doc_id, []).append((r.part, r.start, r.length))
    assert max(room.values()) <= 100 and sorted(room) == list(range(1, len(room) + 1))
    sizes = {i: n for i, n in rows if n}
    assert {i: sum(x[2] for x in ps) for i, ps in parts.items()} == sizes
    assert all(len(ps) == 1 or sizes[i] > 100 for i, ps in parts.items())
    assert sum(room.values()) / (len(room) * 100) > 0.97
    again = P.pack(df, 100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert P.pack(df.where("false"), 100).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, n_tokens string")
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


# ---- 9


def test_flow_is_cheapest():
    room = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    flow = X.min_cost_flow({"a": 150, "b": 60}, room, {"a": 2, "b": 3})
    assert sum(v for (s, _), v in flow.items() if s == "a") == 150 and sum(v for (s, _), v in flow.items() if s == "b") == 60
    assert flow["a", ("a",)] == 100 and flow["b", ("b",)] == 10  # first uses before second ones
    assert X.min_cost_flow({}, {}, {}) == {}
    capped = X.min_cost_flow({"a": 1000}, {("a",): 100}, {"a": 3})
    assert capped == {("a", ("a",)): 300}


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaab"), f"t{i % 700}", rnd.randrange(1, 60)) for i in range(1000)]
    size = {k: n for _, _, k, n in rows}
    rows = [(i, s, k, size[k]) for i, s, k, _ in rows] + [(5000, None, "n", 5), (5001, "c", "z", 0), (0, rows[0][1], "t0", size["t0"])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text_key string, n_tokens long").withColumn("copies", F.lit(99))
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.4, 3), ("m", "none", 0.1, 1), ("n", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = X.mix(df, targets)
    by = {(r.mix_name, r.source): r for r in shares.collect()}
    assert by["m", "none"].share == 0 and by["n", "a"].share == 1
    assert by["m", "a"].share == pytest.approx(5 / 9, abs=0.01) and by["m", "b"].share == pytest.approx(4 / 9, abs=0.01)
    assert by["m", "a"].most_copies <= 2 and by["m", "b"].most_copies <= 3
    assert chosen.groupBy("mix_name", "source", "doc_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, X.mix(df, targets)[0].collect())) == sorted(map(tuple, chosen.collect()))
    empty = X.mix(df.where("false"), targets)
    assert empty[0].count() == 0 and {r.share for r in empty[1].collect()} == {0.0}


# ---- 1


def test_titles():
    t = M.split_title("drenulick_foundations-of-remote-tokens_2010")
    assert (t["person"], t["main"], t["year"]) == ("drenulick", "foundations of remote tokens", 2010)
    assert M.split_title("J. Smith - A Title Of It (draft)")["person"] == "J. Smith"
    assert M.split_title("Books: Part 2")["mark"] == M.split_title("Books. Volume II")["mark"] == "part2" != M.split_title("Books")["mark"]
    assert M.split_title("Хрупкие каталоги и надёжные буферы")["main"] == M.split_title("Khrupkie katalogi i nadezhnye bufery")["main"]
    assert M.split_title(None)["main"] == M.split_title("  ")["main"] == ""
    assert [M.first_year(x) for x in ("D:20030518", "c2006", "Oct 9, 2025", "x", None)] == [2003, 2006, 2025, None, None]


@pytest.fixture(scope="module")
def works(spark):
    rnd = random.Random(5)
    adj = "quiet ordered shared narrow remote frozen silent stable dense coarse lazy tidy brittle granular elastic".split()
    noun = "rivers ledgers cursors windows readers tokens shards queues filters anchors buffers records pages streams".split()
    names = "".join
    people = [names(rnd.choice(["Bral", "Korn", "Vand", "Orb", "Mirr", "Tymb"]) + rnd.choice(["a", "o", "ei", "ou"]) + rnd.choice(["sen", "vik", "rell", "dorn", "quist"])) for _ in range(60)]
    title = lambda: f"{rnd.choice(adj)} {rnd.choice(noun)} beyond {rnd.choice(adj)} {rnd.choice(noun)} in {rnd.choice(adj)} {rnd.choice(noun)}".title()
    works = [(title(), rnd.sample(people, 2), rnd.randrange(1980, 2025)) for _ in range(300)]
    files, entries, truth = [], [], set()
    for i, (t, p, y) in enumerate(works):
        if i % 2 == 0:
            files.append((i, t, "; ".join(p), str(y)))
            if i % 20 == 0:
                files.append((i + 5000, t.upper(), None, None))
    for j in range(600):
        i = rnd.randrange(300)
        t, p, y = works[i]
        k = rnd.randrange(len(t))
        t = t[:k] + t[k + 1 :] if j % 3 == 0 else t
        entries.append((10_000 + j, t, " and ".join(f"A. {x}" for x in p) if j % 7 else None, str(y) if j % 5 else None))
        if i % 2 == 0:
            truth.add((i, 10_000 + j))
            if i % 20 == 0:
                truth.add((i + 5000, 10_000 + j))
    files += [(9000, None, None, None), (9001, "", "", ""), files[0]]
    entries += [(20_000, None, None, None), (20_001, "", " ", ""), (20_002, "Nothing of the kind here", "X. Yz", "1900"), entries[0]]
    schema = "id long, title string, persons string, issued string"
    extra = lambda rows: spark.createDataFrame(rows, schema).withColumn("rid", F.lit(1)).withColumn("kind", F.lit("z"))
    return extra(files), extra(entries), truth


def test_matches(works):
    files, entries, truth = works
    got = {(r.id, r.id2) for r in M.match(files, entries).collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_rounds_write_no_table_of_all_pairs(works, monkeypatch):
    """Only the links of files are written in a round; pairs of other files are neither written again nor shuffled."""
    names, keep = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, name="step": (names.append(name), keep(df, name))[1])
    M.match(*works[:2])
    assert names.count("pairs") == 1 and "scored" not in names


def test_no_rows_to_match(works):
    files, entries, _ = works
    assert M.match(files.where("false"), entries).count() == 0
    assert M.match(files, entries.where("false")).count() == 0


def test_linked_files_agree(spark):
    schema = "a long, b long, kind string, title double, subtitle double, persons double, year double, mark double, g double"
    none = (None,) * 5
    rows = [(1, 2, "within", *none, 0.95), (1, 10, "across", *none, 0.99), (2, 10, "across", *none, 0.3), (1, 11, "across", *none, 0.01), (2, 11, "across", *none, 0.6), (3, 11, "across", *none, 0.6), (1, 12, "across", *none, 0.9)]
    got = {(r.a, r.b): r.g for r in M.transitive(spark.createDataFrame(rows, schema)).where("kind = 'across'").collect()}
    assert got[2, 10] == pytest.approx(0.99 * 0.95) and got[2, 12] == pytest.approx(0.9 * 0.95)  # raised, and come in
    assert got[2, 11] < 0.5 and got[3, 11] == 0.6  # lowered, but only of a linked file


def test_blocking_keys_meet_what_brute_force_finds(works):
    """Candidates against all pairs of the files whose id is divisible by 50 that are alike in title."""
    files, entries, _ = works
    a, b = M.records(files, spread=1)[0].cache(), M.records(entries)[0].cache()
    pairs = {(r.a, r.b) for r in M.candidates(a, b).where("kind = 'across'").collect()}
    some, all_ = [r for r in a.collect() if r.rid % 50 == 0], b.collect()
    alike = {(x.rid, y.rid) for x in some for y in all_ if x.main and y.main and M.title_similarity((x.main, x.sub), (y.main, y.sub), False) >= 0.8}
    assert len(alike) > 5 and len(alike & pairs) / len(alike) > 0.98


def test_similarities_all_at_once():
    rnd = random.Random(5)
    words = "amber ledgers of remote harbours and 2 broken vallei orchards x".split()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    rows = [(text(6) or "a", text(6) or "b", text(4), text(4), rnd.random() < 0.3) for _ in range(600)]
    rows += [(a, a[: rnd.randrange(1, len(a) + 1)].strip() or "c", sa, "", cut) for a, _, sa, _, cut in rows]
    ma, mb, sa, sb, cut = (list(x) for x in zip(*rows, strict=True))
    assert M.dice_all(ma, mb).tolist() == [M.dice(x, y) for x, y in zip(ma, mb, strict=True)]
    got = M.title_similarities((ma, mb), (sa, sb), np.array(cut)).tolist()
    assert got == [M.title_similarity((a, c), (b, d), e) for a, b, c, d, e in rows]
    assert len(M.dice_all([], [])) == 0
    assert M.subtitle_similarity(["amber ledgers", "abc", "amber"], ["amber", "abc", "harbour"]) == [1.0, None, None]


def test_many_unlike_pairs_leave_the_matches(spark):
    """A blocking that brings in ever more pairs of other works must not make a second group of them."""
    rnd = np.random.default_rng(4)

    def group(n, title, persons, year):
        some = lambda values, share: np.where(rnd.random(n) < share, values, np.nan)
        return np.stack([np.clip(rnd.normal(title, 0.1, n), 0, 1), np.full(n, np.nan), some(persons, 0.7), some(year, 0.6), np.ones(n)], axis=1)

    x = np.concatenate([group(1000, 0.97, 1.0, 1.0), group(40_000, 0.4, 0.0, 0.0), group(9000, 0.42, 0.0, 1.0), group(9000, 0.42, 0.6, 0.4)])
    for times in (1, 3, 10):
        model = M.fit(x, np.where(np.arange(len(x)) < 1000, 1.0, times))
        g = model.gamma(x)
        assert (g[:1000] > 0.5).mean() > 0.9 and (g[1000:] > 0.5).mean() < 0.01


def test_bins_are_bounded(spark):
    rnd = random.Random(1)
    rows = [tuple(rnd.choice([None, rnd.random()]) for _ in range(3)) + (rnd.choice([None, 1.0, 0.7]), rnd.choice([None, 0.0, 1.0])) for _ in range(2000)]
    x, n = M.binned(spark.createDataFrame(rows, "title double, subtitle double, persons double, year double, mark double"))
    assert n.sum() == 2000 and len(n) <= M.BINS and x.shape == (len(n), 5)
