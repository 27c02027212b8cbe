"""Mixing sources to target weights (problem 9).

Sources overlap: the same text may lie in several. Texts are aggregated by membership pattern (the set of a mix's
sources that hold them); only the patterns' token sums, a small table, go to the driver. There a min-cost flow routes
tokens from patterns to the sources' quotas. The k-th use of a pattern's tokens costs k, within a source and over all
sources, so repetition is spread evenly and a source turns to texts that others don't use; a source may use a pattern
at most ``max_repeats`` times. The flow is turned into whole passes over a pattern and a range of its seeded order,
and a last step fills what whole documents left open.

The total is the largest at which every source that has documents reaches its share (shares are taken relative to
those sources; one without documents gets 0 and is reported), unless ``total_tokens`` says otherwise; then sources
that can't reach their quota give all they may. Null source, null or empty text: no part in any mix. Same text twice
in one source: one text, used under its lowest doc_id. A repeated row counts once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialise, maybe_broadcast

SEED = 7
#: Parts of a pattern's seeded order; a prefix sum runs over parts first and then within one.
PARTS = 1024
#: A source may end so much above its quota, as part of it; else a last document can miss by a token or two.
SLACK = 0.001
#: Documents of each size (to a power of two) among which a source's last ones are chosen.
TAIL = 8


def min_cost_flow(quota: dict[str, int], room: dict[tuple[str, ...], int], repeats: dict[str, int]) -> dict[tuple[str, tuple[str, ...]], int]:
    """Tokens of each pattern for each source: successive shortest paths with potentials on the small graph."""
    nodes: dict[object, int] = {}

    def node(x: object) -> int:
        return nodes.setdefault(x, len(nodes))

    start, end = node("start"), node("end")
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: dict[int, list[int]] = defaultdict(list)

    def arc(a: int, b: int, c: int, w: int) -> int:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
        return len(to) - 2

    flows: dict[tuple[str, tuple[str, ...]], list[int]] = defaultdict(list)
    for s, q in quota.items():
        arc(start, node(("s", s)), q, 0)
    for p, w in room.items():
        most = 0
        for s in p:
            if s in quota:
                for k in range(repeats[s]):
                    flows[s, p].append(arc(node(("s", s)), node(("p", p)), w, k))
                most += repeats[s]
        for k in range(most):
            arc(node(("p", p)), end, w, k)
    n = len(nodes)
    potential = [0] * n
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                if cap[e] > 0 and (nd := d + cost[e] + potential[a] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if dist[end] == float("inf"):
            break
        for i in range(n):
            if dist[i] < float("inf"):
                potential[i] += int(dist[i])
        push, x = None, end
        while x != start:
            push = cap[via[x]] if push is None else min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = end
        while x != start:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return {k: t for k, es in flows.items() if (t := sum(cap[e ^ 1] for e in es))}


def quotas(shares: dict[str, float], repeats: dict[str, int], held: dict[str, int], total: int | None) -> dict[str, int]:
    """Tokens wanted of each source that holds any."""
    live = {s: w for s, w in shares.items() if held.get(s, 0) > 0 and repeats[s] > 0 and w > 0}
    whole = sum(live.values())
    if not live:
        return {}
    if total is None:
        total = int(min(repeats[s] * held[s] / (w / whole) for s, w in live.items()))
    return {s: int(total * w / whole) for s, w in live.items()}


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """sizes (doc_id, source, text_key, n_tokens), targets (mix_name, source, target_share, max_repeats).

    -> chosen (mix_name, source, doc_id, n_tokens, copies), shares (mix_name, source, target_share, documents, tokens,
    share, most_copies).
    """
    spark = sizes.sparkSession
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats").distinct()
    texts = sizes.where("source IS NOT NULL AND n_tokens > 0").groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    member = texts.join(F.broadcast(wanted.select("mix_name", "source")), "source")
    # the pattern of a text is a set of at most as many sources as targets names
    pattern = member.groupBy("mix_name", "text_key").agg(F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern"), F.max("n_tokens").alias("n_tokens"))
    order = F.xxhash64(F.lit(seed), "text_key")
    pattern = materialise(pattern.withColumn("order", order).withColumn("bin", F.pmod(F.shiftright("order", 20), F.lit(PARTS)).cast("int")), "patterns")
    bins = pattern.groupBy("mix_name", "pattern", "bin").agg(F.sum("n_tokens").alias("w"))
    room = bins.groupBy("mix_name", "pattern").agg(F.sum("w").alias("w")).collect()  # one row per membership pattern
    plan = []
    for name, rows in _by([(r, r.mix_name) for r in wanted.collect()]).items():
        shares, repeats = {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows}
        rooms = {tuple(r.pattern.split("\x1f")): r.w for r in room if r.mix_name == name}
        held: dict[str, int] = defaultdict(int)
        for p, w in rooms.items():
            for s in p:
                held[s] += w
        used: dict[tuple, int] = defaultdict(int)
        for (s, p), x in sorted(min_cost_flow(quotas(shares, repeats, held, total_tokens), rooms, repeats).items()):
            w = rooms[p]
            plan.append((name, s, "\x1f".join(p), w, x // w, used[p] % w, x % w))
            used[p] += x % w
    schema = "mix_name string, source string, pattern string, w long, passes long, off long, rest long"
    routes = spark.createDataFrame(plan, schema)
    before = Window.partitionBy("mix_name", "pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).drop("w")
    within = Window.partitionBy("mix_name", "pattern", "bin").orderBy("order", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    # one shuffle serves this join and the window; sent to all, the bins would be patterns x PARTS rows
    placed = pattern.join(bins.hint("merge"), ["mix_name", "pattern", "bin"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    routed = placed.join(maybe_broadcast(routes), ["mix_name", "pattern"])
    # a text has the extra use if all of it lies in the source's range [off, off + rest) of the pattern, taken as a circle
    gone = F.pmod(F.col("at") - F.col("off"), F.col("w"))
    copies = F.col("passes") + F.when(gone + F.col("n_tokens") <= F.col("rest"), 1).otherwise(0)
    pool = routed.select("mix_name", "source", "text_key", copies.alias("copies"), "order").join(texts, ["source", "text_key"])
    pool = materialise(pool.select("mix_name", "source", "doc_id", "n_tokens", "copies", "order"), "pool")
    goal = routes.groupBy("mix_name", "source").agg(F.sum(F.col("passes") * F.col("w") + F.col("rest")).alias("goal"))
    for _ in range(2):
        pool = materialise(_fill_prefix(pool, goal, wanted), "pool")
    add = spark.createDataFrame(_last(_tail(pool, goal, wanted).collect()), "mix_name string, source string, doc_id long, more int")  # TAIL for each power of two and source
    pool = materialise(pool.join(F.broadcast(add), ["mix_name", "source", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), "pool")
    chosen = pool.where("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", F.col("copies").cast("int").alias("copies"))
    got = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    shares = wanted.join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("most_copies", F.coalesce("most_copies", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return chosen, shares.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))


def _open(pool: DataFrame, goal: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents that may be used once more, with what their source still lacks (one row per mix and source)."""
    now = pool.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("now"))
    gap = goal.join(now, ["mix_name", "source"], "left").join(wanted, ["mix_name", "source"]).select("mix_name", "source", (F.col("goal") * (1 + SLACK) - F.coalesce("now", F.lit(0))).alias("gap"), "max_repeats")
    return pool.join(F.broadcast(gap), ["mix_name", "source"]).where("copies < max_repeats")


def _tail(pool: DataFrame, goal: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the documents that fit into what a source lacks, ``TAIL`` of every power of two in size: the least used, then the largest."""
    free = _open(pool, goal, wanted).where("n_tokens <= gap").withColumn("size", F.floor(F.log2(F.col("n_tokens").cast("double"))))
    rank = Window.partitionBy("mix_name", "source", "size").orderBy("copies", F.desc("n_tokens"), "order", "doc_id")
    return free.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= TAIL).select("mix_name", "source", "doc_id", "n_tokens", "copies", "gap")


def _last(rows: list) -> list[tuple[str, str, int, int]]:
    """One more use of the largest of the least used documents that fit, until none fits."""
    out = []
    for (name, source), own in _by([(r, (r.mix_name, r.source)) for r in rows]).items():
        gap = own[0].gap
        for r in sorted(own, key=lambda r: (r.copies, -r.n_tokens, r.doc_id)):
            if r.n_tokens <= gap:
                gap -= r.n_tokens
                out.append((name, source, r.doc_id, 1))
    return out


def _fill_prefix(pool: DataFrame, goal: DataFrame, wanted: DataFrame) -> DataFrame:
    """One more use of documents of up to an eighth of the gap, least used first and then in seeded order, while their sum stays within it."""
    free = _open(pool, goal, wanted).where("n_tokens * 8 <= gap").withColumn("part", F.col("copies") * PARTS + F.pmod(F.shiftright("order", 20), F.lit(PARTS)))
    sums = free.groupBy("mix_name", "source", "part").agg(F.sum("n_tokens").alias("w"))
    before = Window.partitionBy("mix_name", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).drop("w")
    within = Window.partitionBy("mix_name", "source", "part").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = free.join(sums.hint("merge"), ["mix_name", "source", "part"]).where("before < gap").withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    more = upto.where("upto <= gap").select("mix_name", "source", "doc_id", F.lit(1).alias("more"))
    return pool.join(more, ["mix_name", "source", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def _by(rows: list[tuple]) -> dict:
    """Rows by key, from pairs of both."""
    out: dict = defaultdict(list)
    for r, key in rows:
        out[key].append(r)
    return out
