"""Most similar vectors for every vector, by cosine similarity (problem 6).

NN-descent. Vectors that are equal number by number are one point of the graph. Random-projection trees, fitted on a
bounded sample (``FIT_ROWS``), lay all points into small blocks, several times over; the best of a point's
block mates start its neighbour list. Then, round by round, Spark joins bring to every block the neighbours of its
points, those they list and those that list them, each vector once per block. What is beside a point meets there, and
every point keeps the best ``WIDTH`` of those it met.
A block larger than intended, as in a dense topic, is split by a hash, so no task grows with a hot group; what the
split parts, the rounds bring together again.

Queries walk the graph greedily (``search``): from entry points of the whole and of the query's own blocks, expand the
most similar points not yet expanded until all that are kept are expanded.

Vectors that are null, hold null or other than finite numbers, are all zeros, or have another length than most take no
part. Lists of copies are cut by id only where the copies alone fill the k places. The width of lists during the
rounds bounds the search as in the published method; recall against brute force is measured in the tests.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import discard, materialise, maybe_broadcast, together

K = 10
#: Entries a point keeps; in a round all of them and as many reverse ones meet, and the other reverse ones meet its entries.
WIDTH = 20
TREES = 4
#: Rounds end when one brings in a smaller share of entries than this.
SETTLED = 0.03
BLOCK = 1200
#: A round goes through the blocks in up to so many parts, one for as many points, and deletes what one shuffled before the next.
PARTS = 8
PART_POINTS = 12_000
FIT_ROWS = 20_000
#: Entry points drawn from all points, and from every block of every tree.
ENTRIES = 256
BLOCK_ENTRIES = 32


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v, key): unit vectors as 2-byte floats, and the digest of the numbers given.

    The length that most vectors have is the length of all.
    """
    fine = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & F.exists("e", lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("e") == (sizes.n if sizes else 0)).dropDuplicates(["vec_id"])


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            m = np.stack(b["e"].to_numpy()).astype(np.float64)
            m /= np.abs(m).max(axis=1, keepdims=True)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.DataFrame({"id": b["id"], "n": b["n"], "low": b["low"], "v": [x.tobytes() for x in m.astype(np.float16)], "e": [x.tobytes() for x in m]})


def points(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector: id (its lowest vec_id), n copies, the K + 1 lowest ids, v (2-byte), e (8-byte)."""
    u = usable(vectors)
    keyed = u.withColumn("key", F.sha2(F.concat_ws(",", F.transform("e", lambda x: (x + 0.0).cast("string"))), 256))
    ranked = keyed.select("vec_id", "key")
    low = ranked.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    several = low.where("n > 1")
    # the lowest ids of classes of copies: partial top-k before the shuffle, so a hot class stays small
    top = ranked.join(several.select("key"), "key", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_r") <= K + 1)
    lows = top.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("low"))
    one = low.join(lows, "key", "left").select("id", "n", F.coalesce("low", F.array("id")).alias("low"))
    return one.join(u.select(F.col("vec_id").alias("id"), "e"), "id").mapInPandas(_units, "id long, n long, low array<long>, v binary, e binary")


def members(vectors: DataFrame) -> DataFrame:
    """(id, vec_id): which vectors a point stands for."""
    u = usable(vectors).withColumn("key", F.sha2(F.concat_ws(",", F.transform("e", lambda x: (x + 0.0).cast("string"))), 256)).select("vec_id", "key")
    return u.join(u.groupBy("key").agg(F.min("vec_id").alias("id")), "key").select("id", "vec_id")


class Tree:
    """A random-projection tree; below what the sample can fit, halves are drawn through the middle of all points."""

    def __init__(self, sample: np.ndarray, total: int, block: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normals, self.cuts, self.kids = [], [], []
        self.leaves = 0
        scale = len(sample) / max(1, total)
        self._grow(sample, rng, max(8, block * scale))
        mean = total / max(1, self.leaves)
        self.extra = [rng.normal(size=sample.shape[1]).astype(np.float32) for _ in range(int(np.ceil(np.log2(mean / block))) if mean > 1.5 * block else 0)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, least: float) -> int:
        if len(rows) <= least * 1.5 or len(rows) < 4:
            self.leaves += 1
            return -self.leaves
        a, b = rng.choice(len(rows), 2, replace=False)
        normal = rows[a] - rows[b]
        if not np.any(normal):
            normal = rng.normal(size=rows.shape[1]).astype(np.float32)
        side = rows @ normal
        cut = float(np.median(side))
        left = side < cut
        if left.all() or not left.any():
            self.leaves += 1
            return -self.leaves
        at = len(self.normals)
        self.normals.append(normal)
        self.cuts.append(cut)
        self.kids.append((0, 0))
        self.kids[at] = (self._grow(rows[left], rng, least), self._grow(rows[~left], rng, least))
        return at

    def leaf(self, m: np.ndarray) -> np.ndarray:
        at = np.zeros(len(m), dtype=np.int64) if self.normals else np.full(len(m), -1, dtype=np.int64)
        if self.normals:
            normals, cuts, kids = np.stack(self.normals), np.array(self.cuts), np.array(self.kids)
            while (inner := np.flatnonzero(at >= 0)).size:
                here = at[inner]
                right = np.einsum("ij,ij->i", m[inner], normals[here]) >= cuts[here]
                at[inner] = kids[here, right.astype(int)]
        for normal in self.extra:
            at = at * 2 - (m @ normal >= 0)
        return -at


def _matrix(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), dtype=np.float32)
    return np.frombuffer(b"".join(column), dtype=np.float16).reshape(len(column), -1).astype(np.float32)


def _assign(trees: list[Tree]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = _matrix(b["v"])
                for t, tree in enumerate(trees):
                    yield pd.DataFrame({"id": b["id"], "v": b["v"], "tree": t, "leaf": tree.leaf(m)})

    return run


def _block_start(t: pa.Table) -> pa.Table:
    ids, m = t["id"].to_numpy(), _matrix(t["v"].to_pylist())
    width = min(WIDTH, len(ids) - 1)
    sims_of, at_of = [np.zeros((0, width), dtype=np.float32)], [np.zeros((0, width), dtype=np.int64)]
    for at in range(0, len(ids), 512):
        sims = m[at : at + 512] @ m.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -9
        part = np.argpartition(-sims, max(0, width - 1), axis=1)[:, :width]
        at_of.append(part)
        sims_of.append(np.take_along_axis(sims, part, axis=1))
    return _grouped(ids, np.repeat(np.arange(len(ids)), width), np.concatenate(sims_of).ravel(), ids[np.concatenate(at_of).ravel()], np.ones(len(ids) * width, dtype=bool))


#: Numbers as block ids: they sort without comparing texts.
_NEAR = "array<struct<sim:float,id:long,new:boolean>>"


def laid_out(pts: DataFrame, block: int = BLOCK, trees: int = TREES, seed: int = 11, also: DataFrame | None = None) -> DataFrame:
    """(id, v, block, tree): the block of every point in each tree; of ``also`` (id, v) too, with a column own = False."""
    spark = pts.sparkSession
    total = pts.count()
    sample = pts.select("v").orderBy(F.xxhash64("id")).limit(FIT_ROWS).collect()  # the bounded sample the trees are fitted on
    fitted = [Tree(_matrix([bytes(r.v) for r in sample]), total, block, seed + t) for t in range(trees)]
    shared = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _assign(shared.value)(batches)

    lay = lambda df: df.select("id", "v").mapInPandas(assign, "id long, v binary, tree int, leaf long")
    laid = materialise(lay(pts), "laid")
    sizes = laid.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("split"))
    every = laid if also is None else laid.withColumn("own", F.lit(True)).unionByName(lay(also).withColumn("own", F.lit(False)))
    return every.join(maybe_broadcast(sizes), ["tree", "leaf"]).withColumn("block", (F.col("leaf") * trees + F.col("tree")) * 100_000 + F.pmod(F.xxhash64("id", "tree"), F.col("split"))).drop("leaf", "split")


def start(pts: DataFrame, block: int = BLOCK, trees: int = TREES, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(id, block) of the first tree, and the starting lists (id, near)."""
    blocks = laid_out(pts, block, trees, seed)
    near = blocks.select("block", "id", "v").groupBy("block").applyInArrow(_block_start, f"id long, near {_NEAR}")
    return blocks.where("tree = 0").select("id", "block"), merged(near)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists and all of their values."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()


def _grouped(ids: np.ndarray, owner: np.ndarray, sims: np.ndarray, to: np.ndarray, new: np.ndarray) -> pa.Table:
    """(id, near): of ids[owner], which is in order."""
    ends = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
    near = pa.StructArray.from_arrays([pa.array(sims, pa.float32()), pa.array(to, pa.int64()), pa.array(new, pa.bool_())], names=["sim", "id", "new"])
    return pa.table({"id": pa.array(ids, pa.int64()), "near": pa.ListArray.from_arrays(ends, near)})


def _first(owner: np.ndarray, many: int) -> np.ndarray:
    """Whether a row is one of the first ``many`` of its owner; owners are in order."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner) < many


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists with repeated entries the WIDTH best, each once; one that was there before is not new."""
    for b in batches:
        t = pa.Table.from_batches([b])
        n, x = _flat(t["near"])
        owner, sims, to, new = np.repeat(np.arange(len(n)), n), *(x.field(c).to_numpy(zero_copy_only=False) for c in ("sim", "id", "new"))
        order = np.lexsort((-sims, new, to, owner))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (owner[order][1:] == owner[order][:-1]) & (to[order][1:] == to[order][:-1])
        order = order[~same]
        order = order[np.lexsort((to[order], -sims[order], owner[order]))]
        order = order[_first(owner[order], WIDTH)]
        yield from _grouped(t["id"].to_numpy(), owner[order], sims[order], to[order], new[order]).to_batches()


def merged(lists: DataFrame) -> DataFrame:
    """(id, near) in several rows of an id -> one row of each."""
    return lists.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near")).mapInArrow(_merged, f"id long, near {_NEAR}")


#: Points whose members are compared at once.
JOINED = 256


def _round(t: pa.Table) -> pa.Table:
    """One block: own points with their members, the first ``fresh`` of them new, and all members once with vectors and what is of use to them."""
    is_own = t["own"].combine_chunks()
    own, met = t.filter(is_own), t.filter(pc.invert(is_own))
    met = met.take(pc.sort_indices(met["id"]))
    known, least, m = met["id"].to_numpy(), met["least"].to_numpy(), _matrix(met["v"].to_pylist())
    own = own.sort_by([("fresh", "descending"), ("id", "ascending"), ("k", "ascending")])
    n, flat = _flat(own["members"])
    fresh, begins = own["fresh"].to_numpy(), np.cumsum(n) - n
    member = np.searchsorted(known, flat.to_numpy(zero_copy_only=False))
    targets, cands, values = [], [], []
    for at in range(0, int((fresh > 0).sum()), JOINED):
        now = slice(at, min(at + JOINED, int((fresh > 0).sum())))
        place = np.arange(n[now].max())
        there = place < n[now, None]
        who = np.where(there, member[np.where(there, begins[now, None] + place, 0)], 0)
        some = int(fresh[now].max())  # new ones meet all
        is_new = place[:some] < fresh[now, None]
        v = m[who]
        sims = v[:, :some] @ v.transpose(0, 2, 1)
        use = is_new[:, :, None] & there[:, None, :] & (who[:, :some, None] != who[:, None, :])
        for mine, wanted in ((True, use), (False, use & (place >= fresh[now, None])[:, None, :])):
            got = np.nonzero(wanted & (sims > (least[who[:, :some]][:, :, None] if mine else least[who][:, None, :])))
            a, b = who[got[0], got[1]], who[got[0], got[2]]
            targets.append(a if mine else b)
            cands.append(b if mine else a)
            values.append(sims[got])
    if not targets:
        return _grouped(np.zeros(0, dtype=np.int64), *np.zeros((4, 0)))
    target, cand, value = np.concatenate(targets), np.concatenate(cands), np.concatenate(values)
    order = np.lexsort((-value, target * len(known) + cand))
    target, cand, value = target[order], cand[order], value[order]
    once = np.ones(len(target), dtype=bool)
    once[1:] = (target[1:] != target[:-1]) | (cand[1:] != cand[:-1])
    order = np.flatnonzero(once)
    order = order[np.lexsort((cand[order], -value[order], target[order]))]
    # as many as WIDTH of them may be in the point's list already
    order = order[_first(target[order], 2 * WIDTH)]
    ids, owner = np.unique(target[order], return_inverse=True)
    return _grouped(known[ids], owner, value[order], known[cand[order]], np.ones(len(order), dtype=bool))


def best_reverse(edges: DataFrame, parts: int = 32) -> DataFrame:
    """(to, e) -> (id, r): the WIDTH best entries that point to a point; those of a hub are cut in ``parts`` before they meet."""
    best = lambda c: F.slice(F.sort_array(c, asc=False), 1, WIDTH)
    ranked = Window.partitionBy("to", "part").orderBy(F.desc("e.sim"), F.desc("e.id"))
    kept = edges.withColumn("part", F.pmod(F.xxhash64("e.id"), F.lit(parts))).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= WIDTH)
    return kept.groupBy("to").agg(best(F.collect_list("e")).alias("r")).withColumnRenamed("to", "id")


def descend(pts: DataFrame, home: DataFrame, near: DataFrame, parts: int = PARTS) -> DataFrame:
    """One round: the members of every point, those it lists and those that list it, are brought to its block and meet.

    As in the method, only pairs with an entry that is new since the last round are looked at, and each of the two keeps
    the other if it is better than what it has. All points serve every part of the blocks.
    """
    pick = lambda c, flag: F.transform(F.filter(c, lambda x: x.new if flag else ~x.new), lambda x: x.id)
    # of the points that list a point the most similar ones; sort_array over the partial lists needs no window
    edges = near.select("id", F.explode("near").alias("x")).select(F.col("x.id").alias("to"), F.struct(F.col("x.sim").alias("sim"), F.col("id"), F.col("x.new").alias("new")).alias("e"))
    rev = best_reverse(edges)
    none = F.array().cast("array<long>")
    lists = near.join(rev, "id", "left").join(home, "id").join(pts.select("id", "v"), "id")
    lists = lists.select(
        "id", "block", "v", F.when(F.size("near") < WIDTH, -2.0).otherwise(F.array_min(F.transform("near", lambda x: x.sim))).cast("float").alias("least"),
        F.array_union(pick("near", True), F.coalesce(pick("r", True), none)).alias("fresh"), F.array_union(pick("near", False), F.coalesce(pick("r", False), none)).alias("old"),
    )
    members = F.concat("fresh", F.array_except("old", "fresh"), F.array("id"))
    lists = materialise(lists.select("id", "block", "v", "least", F.size("fresh").alias("fresh"), members.alias("members")).repartition("block"), "lists")
    more = materialise(_more(near, edges, lists).repartition("block"), "more")
    own = lists.select("block", "id", F.lit(0).alias("k"), "fresh", "members").unionByName(more).where("fresh > 0")
    steps = [materialise(_part(lists, own.where(F.pmod(F.xxhash64("block"), F.lit(parts)) == part)), "steps") for part in range(parts)]
    discard(own)
    before = near.select("id", F.transform("near", lambda x: F.struct(x.sim.alias("sim"), x.id.alias("id"), F.lit(False).alias("new"))).alias("near"))
    every = before.unionByName(together(steps))
    found = [materialise(merged(every.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)), "found") for part in range(parts)]
    for step in steps:
        discard(step)
    return together(found)


def _more(near: DataFrame, edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(block, id, k, fresh, members): what a point lists, with those that list it and are no members yet; of hubs several rows."""
    size = F.ceil(F.col("count") / (2 * WIDTH)).cast("int")
    many = edges.join(edges.groupBy("to").count().where(F.col("count") > WIDTH), "to").withColumn("k", 1 + F.pmod(F.xxhash64("e.id"), size))
    beside = many.groupBy("to", "k").agg(F.sort_array(F.collect_list("e")).alias("e")).withColumnRenamed("to", "id")
    rows = beside.join(lists.select("id", "block", "members"), "id").join(near, "id")
    pick = lambda c, flag: F.transform(F.filter(c, lambda x: x.new if flag else ~x.new), lambda x: x.id)
    rows = rows.withColumn("e", F.filter("e", lambda x: ~F.array_contains("members", x.id))).where(F.size("e") > 0)
    fresh, old = (F.concat(pick("near", flag), pick("e", flag)) for flag in (True, False))
    return rows.select("block", "id", F.col("k").cast("int").alias("k"), F.size(fresh).alias("fresh"), F.concat(fresh, old).alias("members"))


def _part(lists: DataFrame, own: DataFrame) -> DataFrame:
    """(id, near): what a round finds for the members in ``own``, with vectors of ``lists``; an id in several rows."""
    met = own.select("block", F.explode("members").alias("id")).distinct().join(lists.select("id", "v", "least"), "id")
    everything = own.select("block", "id", F.lit(True).alias("own"), F.lit(None).cast("binary").alias("v"), F.lit(0.0).cast("float").alias("least"), "k", "fresh", "members").unionByName(
        met.select("block", "id", F.lit(False).alias("own"), "v", "least", F.lit(0).alias("k"), F.lit(0).alias("fresh"), F.array().cast("array<long>").alias("members"))
    )
    return everything.groupBy("block").applyInArrow(_round, f"id long, near {_NEAR}")


def changed(after: DataFrame) -> float:
    """Share of the entries of the first K places that a round brought in."""
    top = F.slice("near", 1, K)
    r = after.agg(F.sum(F.size(F.filter(top, lambda x: x.new))).alias("new"), F.sum(F.size(top)).alias("all")).first()
    return (r["new"] or 0) / max(1, r["all"] or 0)


def graph(pts: DataFrame, settled: float = SETTLED, block: int = BLOCK) -> DataFrame:
    """(id, near): for every point its most similar others, best first.

    Rounds end when one brings in less than ``settled`` of the entries; lists only get better, so one does.
    """
    laid, near = start(pts, block)
    home, near = materialise(laid, "home"), materialise(near, "near")
    discard(laid)
    parts = min(PARTS, 1 + home.count() // PART_POINTS)
    while True:
        last, near = near, descend(pts, home, near, parts)
        discard(last)
        if changed(near) < settled:
            break
    return near


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            x = np.frombuffer(b"".join(b["ea"]), dtype=np.float64).reshape(len(b), -1)
            y = np.frombuffer(b"".join(b["eb"]), dtype=np.float64).reshape(len(b), -1)
            yield pd.DataFrame({"id": b["id"], "to": b["to"], "sim": np.einsum("ij,ij->i", x, y)})


def scored(pts: DataFrame, near: DataFrame, least: float = -1.0) -> DataFrame:
    """(id, to, sim) of the graph's edges with exact similarities; edges clearly below ``least`` are left out first."""
    e = near.select("id", F.explode("near").alias("x")).where(F.col("x.sim") >= least - 0.01).select("id", F.col("x.id").alias("to"))
    a, b = pts.select("id", F.col("e").alias("ea")), pts.select(F.col("id").alias("to"), F.col("e").alias("eb"))
    return e.join(b, "to").join(a, "id").mapInPandas(_exact, "id long, to long, sim double").where(F.col("sim") >= least)


def nearest(pts: DataFrame, edges: DataFrame, who: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, rank, neighbour, similarity): the k best of every vector, copies included; ties by id."""
    own = pts.where("n > 1").select("id", F.lit(1.0).alias("sim"), F.explode("low").alias("other"))
    others = edges.join(pts.select(F.col("id").alias("to"), "low"), "to").select("id", "sim", F.explode("low").alias("other"))
    ranked = own.unionByName(others).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("other").alias("o")))).alias("all"))
    each = who.join(ranked, "id").select("vec_id", F.slice(F.expr("filter(all, x -> x.o <> vec_id)"), 1, k).alias("top"))
    return each.select("vec_id", F.posexplode("top").alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("x.o").alias("neighbour"), (-F.col("x.d")).alias("similarity"))


def _halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["query_id"], "v": [np.frombuffer(x, dtype=np.float64).astype(np.float16).tobytes() for x in b["e"]]})


def entries(pts: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, id): points of the query's block in every tree, so that their density does not fall as data grow."""
    laid = laid_out(pts, block, also=queries.select("query_id", "e").mapInPandas(_halved, "id long, v binary")).drop("v")
    drawn = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("id", "tree").alias("h"), "id"))), 1, BLOCK_ENTRIES)
    here = laid.where("own").groupBy("block").agg(drawn.alias("some"))
    return laid.where("NOT own").select("block", F.col("id").alias("query_id")).join(here, "block").select("query_id", F.explode("some.id").alias("id")).distinct()


def _at_entries(queries: DataFrame, entry: DataFrame) -> DataFrame:
    """(query_id, id, sim) of every query (query_id, q) and the ENTRIES points, a matrix that every task has."""
    rows = entry.collect()  # ENTRIES at most
    ids, m = np.array([r.id for r in rows], dtype=np.int64), np.stack([np.frombuffer(r.e, dtype=np.float64) for r in rows]) if rows else None
    shared = queries.sparkSession.sparkContext.broadcast((ids, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = shared.value
        for b in batches:
            if len(b) and len(ids):
                sims = np.frombuffer(b"".join(b["q"]), dtype=np.float64).reshape(len(b), -1) @ m.T
                yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), len(ids)), "id": np.tile(ids, len(b)), "sim": sims.ravel()})

    return queries.select("query_id", "q").mapInPandas(run, "query_id long, id long, sim double")


def search(pts: DataFrame, near: DataFrame, queries: DataFrame, k: int = K, beam: int = 32, step: int = 4, block: int = BLOCK) -> DataFrame:
    """Greedy search: queries (query_id, e as 8-byte unit vector) -> (query_id, rank, id, similarity).

    Each round expands, for every query that has such, the ``step`` best points not expanded yet; ``beam`` points are
    kept. Rounds end when no query keeps a point that is not expanded; a point is met once, so one does. Entry points
    are a bounded sample of all points and some of each block that the query falls into.
    """
    entry = pts.orderBy(F.xxhash64("id")).limit(ENTRIES).select("id", "e")

    def dots(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("query_id").alias("id"), F.col("id").alias("to"), F.col("q").alias("ea"), F.col("e").alias("eb"))
        return named.mapInPandas(_exact, "id long, to long, sim double").select(F.col("id").alias("query_id"), F.col("to").alias("id"), "sim")

    q = materialise(queries.select("query_id", F.col("e").alias("q")), "queries")
    beside = entries(pts, queries, block).join(entry.select("id"), "id", "left_anti").join(pts.select("id", "e"), "id").join(q, "query_id")
    met = _at_entries(q, entry).unionByName(dots(beside))
    kept = F.slice(F.sort_array(F.collect_list(F.struct("sim", "id", F.lit(False).alias("done"))), asc=False), 1, beam)
    state = materialise(met.groupBy("query_id").agg(kept.alias("best")).withColumn("seen", F.transform("best", lambda x: x.id)), "state")
    links = near.select("id", F.transform("near", lambda x: x.id).alias("fwd"))
    waits = F.exists("best", lambda x: ~x.done)
    ended = []
    while True:
        ended.append(state.where(~waits).select("query_id", "best"))
        state = state.where(waits)
        if state.isEmpty():
            break
        open_ = F.slice(F.filter("best", lambda x: ~x.done), 1, step)
        going = state.withColumn("go", F.transform(open_, lambda x: x.id))
        hop = going.select("query_id", "seen", F.explode("go").alias("id")).join(links, "id").select("query_id", F.explode(F.array_except("fwd", "seen")).alias("id")).distinct()
        new = dots(hop.join(pts.select("id", "e"), "id").join(q, "query_id")).groupBy("query_id").agg(F.collect_list(F.struct("sim", "id", F.lit(False).alias("done"))).alias("new"))
        both = going.join(new, "query_id", "left")
        marked = F.transform("best", lambda x: F.struct(x.sim.alias("sim"), x.id.alias("id"), (x.done | F.array_contains("go", x.id)).alias("done")))
        fresh = F.coalesce("new", F.array().cast("array<struct<sim:double,id:long,done:boolean>>"))
        state = materialise(
            both.select("query_id", F.slice(F.sort_array(F.concat(marked, fresh), asc=False), 1, beam).alias("best"), F.array_union("seen", F.transform(fresh, lambda x: x.id)).alias("seen")),
            "state",
        )
    state = functools.reduce(DataFrame.unionByName, ended)
    return state.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.sim").alias("similarity"))
