"""Several values packed in one field (problem 4).

A field is cut into cells at every possible delimiter; a lattice has an edge for every run of cells that could be one
value. Strong delimiters (; | / middle dot, line feed, tab, and the gap between quoted spans) always part values;
commas and conjunctions may belong to a value. A quoted span is one atomic cell. Runs have up to ``RUN`` cells, or are
all that stands between two strong delimiters, however long.

Nothing is assumed of what the values are. Of some values the column itself leaves no doubt: quoted spans, and single
cells between strong delimiters. From these start two frequencies, that of each value and that of kinds of words in
order (a value's shape, as a Markov chain over kinds with the number of commas so far); expectation-maximisation over
all distinct fields then learns both: forward-backward passes give expected counts, which are summed over the column.
A value's probability is that of its shape (in the column, and among the other values of its field) times a constant chance per word, plus its own frequency, which counts as
far as values have such shapes: by the chance of the shape among values over that among all runs. A field's own share
in a value's count is left out when that field is split. Viterbi then picks the split; ties go to the longer value.

Null, blank and delimiter-only fields give no rows. Words for unnamed further authors are no values. Equal fields are
solved once. Repeated input rows give their values once. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialise

#: The longest run of cells that an edge stands for, unless it reaches from one strong delimiter to the next.
RUN = 12
ROUNDS = 3
#: How strongly a value's own frequency is held back where values seldom have its shape.
CAUTION = 3.0
#: Weight of a value's own frequency beside what its shape says.
OWN = 0.5
#: How often a value has its shape from the other values of its field.
ALIKE = 0.2
SETTLED = 0.9
#: Kinds of words, as counts of the chain are smoothed over them.
KINDS = 10
SMOOTH = 0.1

# Quotation marks, conjunctions, words for unnamed further authors, and what may follow a name.
QUOTED = r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|(?<!\w)'[^'\n]*'(?!\w)|(?<!\w)‘[^’\n]*’(?!\w)"
FURTHER = r"(?<!\w)(?:et\s+al\b\.?|et\s+alii\b|and\s+others\b|and\s+colleagues\b|et\s+coll\b\.?|и\s+др\b\.?|и\s+другие\b|та\s+ін\b\.?|та\s+інші\b|u\.\s?a\.|und\s+andere\b|et\s+autres\b|y\s+otros\b)"
CONJUNCTION = r"(?<=[\s,;.\"”»])(?:and|und|et|y|и|та|&)(?=\s)"
SUFFIXES = {"Jr", "Sr", "II", "III", "IV", "мл", "ст"}
QUOTES = "\"“”«»„‘’'"

TOKEN = re.compile(rf"(?P<quoted>{QUOTED})|(?P<further>{FURTHER})|(?P<strong>[;|/·•\n\r\t])|(?P<comma>,)|(?P<conj>{CONJUNCTION})|(?P<text>[^\s;|/·•,]+)|(?P<space>\s)")
WORD = re.compile(r"[^\W\d_](?:[\w’'\-‐]*\w)?\.?|\d+|,|[^\w\s]")
RANK = {"none": 0, "comma": 1, "conj": 2, "strong": 3}


def cells(s: str) -> list[tuple[int, int, bool, str]]:
    """(start, end, quoted, delimiter before) of every non-empty cell."""
    out: list[list] = []
    before, open_ = "strong", False
    for m in TOKEN.finditer(s):
        kind = m.lastgroup
        if kind == "space":
            continue
        if kind in ("strong", "comma", "conj", "further"):
            kind = "strong" if kind == "further" else kind
            before = max(before, kind, key=RANK.get) if not open_ else kind
            open_ = False
        elif kind == "quoted":
            if m.group()[1:-1].strip():
                out.append([m.start(), m.end(), True, "strong"])
            before, open_ = "strong", False
        elif open_:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end(), False, before])
            open_ = True
    kept: list[list] = []
    for x in out:
        text = s[x[0] : x[1]]
        if kept and x[3] == "comma" and not x[2] and not kept[-1][2] and text.strip().rstrip(".") in SUFFIXES:
            kept[-1][1] = x[1]  # what follows a name is part of it
        elif any(c.isalnum() for c in text):
            kept.append(x)
    return [tuple(x) for x in kept]


def shape(value: str) -> str:
    """Word kinds in order: W capitalised, C up to three capitals, I initial, w lower case, 9 digits; repeats collapse."""
    kinds: list[str] = []
    for t in WORD.findall(value):
        bare = t.rstrip(".")
        if t == ",":
            k = ","
        elif bare in SUFFIXES and (kinds or t.endswith(".")):
            k = "j"
        elif t[0].isdigit():
            k = "9"
        elif not t[0].isalpha():
            k = "&" if t == "&" else "x"
        elif len(bare) == 1 and (t.endswith(".") or bare.isupper()):
            k = "I"
        elif len(bare) <= 3 and bare.isupper():
            k = "C"
        elif bare[0].isupper():
            k = "W"
        else:
            k = "&" if bare in ("and", "und", "et", "и", "та", "y") else "w"
        if not (kinds and k == kinds[-1] and k in "ICwx9"):
            kinds.append(k)
    return "".join(kinds)


def steps(sh: str) -> Iterator[tuple[str, str]]:
    """(state, next kind) along a shape; a state is the last three kinds and the number of commas up to two."""
    last, commas = "^^^", 0
    for k in sh + "$":
        yield f"{last}{commas}", k
        last, commas = last[1:] + k, min(2, commas + (k == ","))


def lattice(s: str) -> tuple[int, list[tuple[int, int, str, str, int, bool]]]:
    """Number of cells, and the edges (from, to, value, shape, words, sure)."""
    cs = cells(s)
    m = len(cs)
    parted = [True, *(cs[k][3] == "strong" or cs[k][2] or cs[k - 1][2] for k in range(1, m)), True]  # before each cell, and at the end
    edges = []
    for i in range(m):
        stop = next(k for k in range(i + 1, m + 1) if parted[k])
        for j in sorted({*range(i + 1, min(stop, i + RUN) + 1), *([stop] if parted[i] else [])}):
            quoted = cs[i][2]
            v = s[cs[i][0] : cs[j - 1][1]].strip().strip(QUOTES if quoted else "\"“”«»").strip()
            v = v.rstrip(",; ").strip() if not quoted else v
            if v:
                edges.append((i, j, v, shape(v), max(1, len(WORD.findall(v)) - v.count(",")), j == i + 1 and parted[i] and parted[j]))
    return m, edges


Chain = dict[tuple[str, str], float]


class Model:
    """Log-probability of an edge, from the chains of values' and of all runs' shapes, a value's own count and the cost of a word."""

    def __init__(self, values: Chain, runs: Chain, total: float, words: float):
        self.chains = [(c, self._states(c)) for c in (values, runs)]
        self.total, self.word = max(total, 1.0), math.log(max(words, 2.0))
        self.cached: dict[str, tuple[float, float]] = {}

    @staticmethod
    def _states(chain: Chain) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for (state, _), n in chain.items():
            out[state] += n
        return dict(out)

    def _shape(self, sh: str) -> tuple[float, float]:
        """Log-chance among values, and how far a count of such a value is held back."""
        among = [sum(math.log((chain.get((st, k), 0.0) + SMOOTH) / (states.get(st, 0.0) + SMOOTH * KINDS)) for st, k in steps(sh)) for chain, states in self.chains]
        return among[0], CAUTION * min(0.0, among[0] - among[1])

    def __call__(self, sh: str, words: int, own: float) -> float:
        if sh not in self.cached:
            if len(self.cached) > 100_000:
                self.cached.clear()
            self.cached[sh] = self._shape(sh)
        by_shape = self.cached[sh][0] - words * self.word
        others = own - 1.0  # without the field at hand
        if others <= 1e-3:
            return by_shape
        by_count = math.log(OWN * others / self.total) + self.cached[sh][1]
        hi, lo = max(by_shape, by_count), min(by_shape, by_count)
        return hi + math.log1p(math.exp(lo - hi))


def _score(m: int, edges: list, own: list[float], model: Model) -> list[float]:
    return alike(m, edges, [model(e[3], e[4], o) for e, o in zip(edges, own, strict=True)], model.word)


def posteriors(m: int, edges: list, scores: list[float]) -> list[float]:
    """Probability of each edge by forward-backward."""
    ahead, back = [-math.inf] * (m + 1), [-math.inf] * (m + 1)
    ahead[0] = back[m] = 0.0

    def add(a: float, b: float) -> float:
        if a < b:
            a, b = b, a
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    for e, x in zip(edges, scores, strict=True):
        ahead[e[1]] = add(ahead[e[1]], ahead[e[0]] + x)
    for e, x in zip(reversed(edges), reversed(scores), strict=True):
        back[e[0]] = add(back[e[0]], back[e[1]] + x)
    return [math.exp(ahead[e[0]] + x + back[e[1]] - ahead[m]) for e, x in zip(edges, scores, strict=True)]


def alike(m: int, edges: list, scores: list[float], word: float) -> list[float]:
    """Scores in which a shape is also as likely as the field's other values have it: one field is printed in one way.

    The others are those that the first forward-backward pass leaves little doubt of, without what overlaps the edge.
    """
    p = [x if x > SETTLED else 0.0 for x in posteriors(m, edges, scores)]
    at: dict[int, list[int]] = defaultdict(list)
    by_shape: dict[str, float] = defaultdict(float)
    for n, e in enumerate(edges):
        at[e[0]].append(n)
        by_shape[e[3]] += p[n]
    total, out = sum(p), []
    for e, x in zip(edges, scores, strict=True):
        over = [n for i in range(max(0, e[0] - RUN), e[1]) for n in at[i] if edges[n][1] > e[0]]
        same = by_shape[e[3]] - sum(p[n] for n in over if edges[n][3] == e[3])
        rest = total - sum(p[n] for n in over)
        shared = math.log(ALIKE * same / (rest + 1)) - e[4] * word if same > SETTLED / 2 else -math.inf
        own = math.log1p(-ALIKE) + x
        hi, lo = max(own, shared), min(own, shared)
        out.append(hi + math.log1p(math.exp(lo - hi)))
    return out


def best_path(m: int, edges: list, scores: list[float]) -> list[str]:
    """The values of the most likely split; ties go to the longer value."""
    best: list[tuple[float, int]] = [(-math.inf, -1)] * (m + 1)
    best[0] = (0.0, -1)
    for k, (e, x) in enumerate(zip(edges, scores, strict=True)):
        if best[e[0]][0] + x > best[e[1]][0] + 1e-12:
            best[e[1]] = (best[e[0]][0] + x, k)
    out, at = [], m
    while at > 0:
        k = best[at][1]
        out.append(edges[k][2])
        at = edges[k][0]
    return out[::-1]


_NAMES = ("i", "j", "val", "shape", "words", "sure")
_EDGES = "array<struct<i:int,j:int,val:string,shape:string,words:int,sure:boolean>>"


def _lattices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for s in b["s"]:
            m, edges = lattice(s)
            if m:
                rows.append((s, m, len(edges) > m, [dict(zip(_NAMES, e, strict=True)) for e in edges]))
        yield pd.DataFrame(rows, columns=["s", "m", "open", "edges"])


def _plain(edges) -> list[tuple]:
    return [tuple(e[k] for k in _NAMES) for e in edges]


def _rows(sums: dict[tuple[str, str, str], float]) -> pd.DataFrame:
    return pd.DataFrame([(*k, c) for k, c in sums.items()], columns=["kind", "x", "k", "c"])


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the sure values (v), their chain (s), and the chain of all runs (r)."""
    for b in batches:
        sums: dict[tuple[str, str, str], float] = defaultdict(float)
        for edges in b["edges"]:
            for e in _plain(edges):
                if e[5]:
                    sums["v", e[2], ""] += 1.0
                for st, k in steps(e[3]):
                    sums["r", st, k] += 1.0
                    if e[5]:
                        sums["s", st, k] += 1.0
        yield _rows(sums)


def _expect(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            sums: dict[tuple[str, str, str], float] = defaultdict(float)
            shapes: dict[str, float] = defaultdict(float)
            for m, edges, own in zip(b["m"], b["edges"], b["own"], strict=True):
                edges = _plain(edges)
                for e, p in zip(edges, posteriors(m, edges, _score(m, edges, list(own), model)), strict=True):
                    if p > 1e-6:
                        sums["v", e[2], ""] += p
                        shapes[e[3]] += p
            for sh, p in shapes.items():
                for st, k in steps(sh):
                    sums["s", st, k] += p
            yield _rows(sums)

    return run


def _decide(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            rows = []
            for s, m, edges, own in zip(b["s"], b["m"], b["edges"], b["own"], strict=True):
                edges = _plain(edges)
                rows += [(s, k + 1, v) for k, v in enumerate(best_path(m, edges, _score(m, edges, list(own), model)))]
            yield pd.DataFrame(rows, columns=["s", "pos", "val"])

    return run


def _with_counts(lat: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``own``: for each edge, the expected count of its value so far."""
    each = lat.select("s", F.posexplode("edges").alias("k", "e")).select("s", "k", F.col("e.val").alias("x"))
    got = each.join(counts, "x", "left").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("c", F.lit(0.0)).alias("c")))).alias("_k"))
    return lat.join(got, "s").withColumn("own", F.transform("_k", lambda x: x.c)).drop("_k")


_SUMS = "kind string, x string, k string, c double"


def split_values(fields: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(s) with one row per field -> (s, pos, val) for every distinct field."""
    spark = fields.sparkSession
    blank = F.regexp_replace("s", r"(?U)\s+", "") == ""
    distinct = fields.where(F.col("s").isNotNull() & ~blank).select("s").distinct()
    lat = materialise(distinct.mapInPandas(_lattices, f"s string, m int, open boolean, edges {_EDGES}"), "lattices")
    settled, unsure = lat.where("NOT open"), lat.where("open")
    add = lambda df: df.groupBy("kind", "x", "k").agg(F.sum("c").alias("c"))
    chain = lambda df, kind: {(r.x, r.k): r.c for r in df.where(F.col("kind") == kind).collect()}  # noqa: E731 - KINDS ** 4 times 3 rows at most
    of = lambda df: df.where("kind = 'v'").select("x", "c")
    begun = materialise(add(lat.select("open", "edges").mapInPandas(_begin, _SUMS)), "begun")
    closed = materialise(add(settled.select("open", "edges").mapInPandas(_begin, _SUMS)), "closed")
    runs, words = chain(begun, "r"), lat.agg(F.approx_count_distinct(F.col("edges")[0]["val"])).first()[0] or 2

    def model(values: Chain, counts: DataFrame):
        total = counts.agg(F.sum("c")).first()[0] or 0.0
        return spark.sparkContext.broadcast(Model(values, runs, total, words))

    counts, fixed = of(begun), chain(closed, "s")
    now = model(chain(begun, "s"), counts)
    for _ in range(rounds):
        expected = materialise(add(_with_counts(unsure, counts).select("m", "edges", "own").mapInPandas(_expect(now), _SUMS)), "expected")
        learned = Counter(fixed)
        learned.update(chain(expected, "s"))
        counts = of(closed).unionByName(of(expected)).groupBy("x").agg(F.sum("c").alias("c"))
        now = model(dict(learned), counts)
    chosen = _with_counts(unsure, counts).select("s", "m", "edges", "own").mapInPandas(_decide(now), "s string, pos int, val string")
    plain = settled.select("s", F.posexplode("edges").alias("k", "e")).select("s", (F.col("k") + 1).cast("int").alias("pos"), F.col("e.val").alias("val"))
    return plain.unionByName(chosen)


def explode_values(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per value of ``column``: the keys, ``pos`` from 1 in printed order, and ``val``."""
    rows = records.select(*keys, F.col(column).alias("s")).where(F.col("s").isNotNull()).distinct()
    return rows.join(split_values(rows.select("s")), "s").select(*keys, "pos", "val")
