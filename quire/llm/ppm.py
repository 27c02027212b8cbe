"""Missing or wrong language labels (problem 3).

Prediction by partial matching over bytes: for every language a variable-order context tree (contexts of up to
``ORDER`` bytes) with escape probabilities by method C. The statistics are frozen after training, so the code length of
a byte after its context is a constant, and the trees of all languages are folded into one table per order: n-gram ->
code length in each language, escapes from longer contexts included. A byte is looked up from the longest order down;
whole batches of text are scored by a few array operations.

Training takes a bounded sample of labelled rows (``PER_LANGUAGE`` bodies of each language, by hash). Labels are
noisy, so before the trees grow every body and sentence of the sample is moved to the language its words speak for.

A body is cut into sentences; a Viterbi path over them, with a price in bits for a change of language, gives the
segments. Bodies whose sentences agree, nearly all, skip the path. The confidence of a segment is the softened
probability of its language given the code lengths. Null or letterless bodies have no segment. A repeated row gives
its segments once. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("english", "russian", "german", "french", "spanish", "ukrainian")
# Names and codes of the languages.
SPELLINGS = {
    "english": "english en eng", "russian": "russian ru rus", "german": "german de deu ger deutsch", "french": "french fr fra fre",
    "spanish": "spanish es spa", "ukrainian": "ukrainian uk ukr",
}
BY_SPELLING = {w: k for k, ws in SPELLINGS.items() for w in ws.split()}

ORDER = 5
#: The bound of the training sample, in bodies of each language, and how much of each body it takes.
PER_LANGUAGE = 400
TRAIN_BYTES = 3_000
#: Bits that a change of language between sentences costs.
SWITCH = 24.0
#: Bits are softened by this before they become a confidence.
SOFTEN = 0.05
UNIT = 64  # code lengths are stored in 1/64 bit
SHORT = 12  # a shorter sentence, in bytes, is joined with the next

FOLD = bytes(48 if 48 <= i <= 57 else i for i in range(256))
CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
END = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)(?:[\"')\]]|\xc2\xbb|\xe2\x80[\x9c\x9d])* ")
OPEN, CLOSE = rb"(?:[\"'\[(]|\xc2\xab|\xe2\x80[\x9c\x9e\x98])", rb"(?:[\"'\])]|\xc2\xbb|\xe2\x80[\x9c\x9d\x99])"
PHRASE = re.compile(rb"%s+[^.!?]{1,120}?%s+[.!?,;:]?(?: |$)" % (OPEN, CLOSE))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def label_language(column) -> F.Column:
    """The language that a label names, or null."""
    low = F.lower(F.trim(column))
    pairs = [F.lit(x) for kv in BY_SPELLING.items() for x in kv]
    return F.create_map(*pairs)[low]


def masked(body: str) -> str:
    """Fenced code as white space of the same length: code is in no language."""
    return CODE.sub(lambda m: " " * len(m.group()), body) if "```" in body else body


def prepare(body: str) -> bytes:
    """White space collapsed, lower case, digits alike, without code."""
    return " ".join(masked(body).lower().split()).encode("utf-8", "replace").translate(FOLD)


def sentence_starts(text: bytes) -> list[int]:
    """Where sentences start. A phrase in quotes or brackets without a stop of its own goes with the sentence before it."""
    starts = [0]
    m = PHRASE.match(text)
    held = m.end() if m else 0
    for m in END.finditer(text):
        at = m.end()
        while q := PHRASE.match(text, at):
            at = q.end()
        if at > held and at - starts[-1] >= SHORT and len(text) - at >= SHORT:
            starts.append(at)
    return starts


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """All n-grams of ``length`` bytes as integers; the i-th ends at byte i + length - 1."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = data.astype(np.uint64)
    out = wide[:n].copy()
    for k in range(1, length):
        out <<= np.uint64(8)
        out |= wide[k : k + n]
    return out


class Lookup:
    """Open-addressing table from integers to row numbers."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self.slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.rows[at] < 0
            first = np.zeros(size, dtype=np.int32)
            first[at[free][::-1]] = todo[free][::-1] + 1  # one key wins a free slot
            won = free & (first[at] == todo + 1)
            self.keys[at[won]], self.rows[at[won]] = keys[todo[won]], todo[won]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where absent."""
        at = self.slot(keys)
        rows = self.rows[at]
        got = np.where(self.keys[at] == keys, rows, np.int32(-1))
        open_ = np.flatnonzero((got < 0) & (rows >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.rows) - 1)
            rows = self.rows[at[open_]]
            hit = (self.keys[at[open_]] == keys[open_]) & (rows >= 0)
            got[open_[hit]] = rows[hit]
            open_ = open_[~hit & (rows >= 0)]
        return got


class Trees:
    """The context trees of all languages, folded into tables of code lengths."""

    def __init__(self, samples: dict[str, bytes], order: int = ORDER):
        self.order, n_lang = order, len(LANGUAGES)
        data = [np.frombuffer(samples.get(x) or b" ", dtype=np.uint8) for x in LANGUAGES]
        self.costs: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.seen: list[Lookup] = []
        self.contexts: list[Lookup] = []
        for k in range(order + 1):
            per = [np.unique(grams(d, k + 1), return_counts=True) for d in data]
            union = np.unique(np.concatenate([g for g, _ in per]))
            ctx_union = np.unique(union >> np.uint64(8))
            cost = np.full((len(union), n_lang), np.nan)
            escape = np.zeros((len(ctx_union), n_lang))
            for i, (g, n) in enumerate(per):
                ctx, at, distinct = np.unique(g >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(at, weights=n, minlength=len(ctx))
                cost[np.searchsorted(union, g), i] = np.log2((total[at] + distinct[at]) / n)
                escape[np.searchsorted(ctx_union, ctx), i] = np.log2((total + distinct) / distinct)
            back = np.full((len(union), n_lang), 8.0)
            if k:
                below = self.seen[k - 1].find(union & np.uint64((1 << (8 * k)) - 1))
                back = np.where((below >= 0)[:, None], self.costs[k - 1][np.maximum(below, 0)] / UNIT, 8.0)
            back = back + escape[np.searchsorted(ctx_union, union >> np.uint64(8))]
            cost = np.where(np.isnan(cost), back, cost)
            self.costs.append(np.minimum(np.round(cost * UNIT), 20000).astype(np.int16))
            self.escapes.append(np.round(escape * UNIT).astype(np.int16))
            self.seen.append(Lookup(union))
            self.contexts.append(Lookup(ctx_union))

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each span ``starts[i]:starts[i+1]`` in every language."""
        out = np.zeros((len(data), len(LANGUAGES)), dtype=np.int16)
        left = np.arange(len(data))
        for k in range(self.order, -1, -1):
            early, left = left[left < k], left[left >= k]  # the first bytes have no context so long
            if len(left) * 3 > len(data):
                keys = grams(data, k + 1)[left - k]
            else:
                keys = data[left - k].astype(np.uint64)
                for j in range(k - 1, -1, -1):
                    keys = (keys << np.uint64(8)) | data[left - j]
            rows = self.seen[k].find(keys)
            hit = rows >= 0
            out[left[hit]] += self.costs[k][rows[hit]]
            left, keys = left[~hit], keys[~hit]
            ctx = self.contexts[k].find(keys >> np.uint64(8))
            known = ctx >= 0
            out[left[known]] += self.escapes[k][ctx[known]]
            left = np.concatenate([early, left])
        out[left] += 8 * UNIT
        return np.add.reduceat(out, starts, axis=0, dtype=np.int32) / UNIT


WORDS = re.compile(r"[^\W\d_]+")


def settle(bodies: list[tuple[str, list[bytes]]], rounds: int = 3, together: float = 6.0) -> list[list[str]]:
    """The language of each sentence of labelled bodies, by the words it has: labels are often wrong for a rare language.

    A word speaks for the languages in whose share of the sample it is common. Words of another language that slipped
    in under a wrong label are rarer there than under their own, so a body finds its language; a sentence leaves its
    body's language only if its words say so clearly (by ``together`` nats).
    """
    words = [[WORDS.findall(s.decode("utf-8", "replace")) for s in ss] for _, ss in bodies]
    names = [[lang] * len(ss) for lang, ss in bodies]
    for _ in range(rounds):
        counts: dict[str, Counter] = defaultdict(Counter)
        for ns, wss in zip(names, words, strict=True):
            for lang, ws in zip(ns, wss, strict=True):
                counts[lang].update(ws)
        sizes = {k: math.log(sum(c.values()) + 100.0) for k, c in counts.items()}
        names = []
        for (lang, _), wss in zip(bodies, words, strict=True):
            each = [{k: sum(math.log(c[w] + 0.01) - sizes[k] for w in ws) for k, c in counts.items()} for ws in wss]
            body = max(counts, key=lambda k: (sum(x[k] for x in each), k == lang))  # noqa: B023
            names.append([max(counts, key=lambda k: (x[k] + together * (k == body), k == body)) for x in each])  # noqa: B023
    return names


def train(bodies: list[tuple[str, str]], order: int = ORDER) -> Trees:
    """Trees from (language, body) rows with noisy labels."""
    cut: list[tuple[str, list[bytes]]] = []
    for lang, body in sorted(bodies):
        text = prepare(body[:TRAIN_BYTES])
        starts = [*sentence_starts(text), len(text)]
        cut.append((lang, [text[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]))
    clean: dict[str, list[bytes]] = defaultdict(list)
    for (_, sentences), names in zip(cut, settle(cut), strict=True):
        for lang, s in zip(names, sentences, strict=True):
            clean[lang].append(s)
    return Trees({k: b"\n".join(v) for k, v in clean.items()}, order)


def training_rows(tables: list[DataFrame], per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows of tables (lang, body): the lowest hashes of each language."""
    from pyspark.sql import Window

    out: list[tuple[str, str]] = []
    for df in tables:
        rows = df.select(label_language(F.col("lang")).alias("lang"), "body").where(F.col("lang").isNotNull() & F.col("body").rlike(r"\p{L}{3}"))
        w = Window.partitionBy("lang").orderBy(F.xxhash64("body"), "body")
        top = rows.select("lang", F.substring("body", 1, TRAIN_BYTES).alias("body")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language)
        out += [(r.lang, r.body) for r in top.collect()]  # at most per_language rows of each language and table
    return out


def path(bits: np.ndarray, switch: float = SWITCH) -> list[int]:
    """The cheapest language of every sentence when a change costs ``switch`` bits."""
    best, back = bits[0], []
    for row in bits[1:]:
        stay = int(np.argmin(best))
        came = np.where(best <= best[stay] + switch, np.arange(len(best)), stay)
        back.append(came)
        best = best[came] + switch * (came != np.arange(len(best))) + row
    at = [int(np.argmin(best))]
    for came in reversed(back):
        at.append(int(came[at[-1]]))
    return at[::-1]


def confidence(bits: np.ndarray, pick: int) -> float:
    d = (bits - bits[pick]) * SOFTEN
    return float(1.0 / np.exp2(-np.clip(d, -500, 500)).sum())


def _offsets(body: str, counts: list[int]) -> list[int]:
    """Positions in the body after so many characters that are no white space."""
    out, seen, want = [], 0, iter(counts)
    nxt = next(want, None)
    for i, c in enumerate(body):
        if nxt is None:
            break
        if not c.isspace():
            while nxt is not None and seen == nxt:
                out.append(i)
                nxt = next(want, None)
            seen += 1
    return out + [len(body)] * (len(counts) - len(out))


def segments(trees: Trees, bodies: list[str | None]) -> list[list[tuple[int, str, float, int, int]]]:
    """Of every body its segments (number, language, confidence, start, stop), positions in the body."""
    texts = [prepare(b) if b else b"" for b in bodies]
    texts = [t if any(97 <= c <= 122 or c > 127 for c in t) else b"" for t in texts]
    starts: list[int] = []
    first: list[int] = []
    at = 0
    for t in texts:
        first.append(len(starts))
        if t:
            starts += [at + s for s in sentence_starts(t)]
            at += len(t)
    first.append(len(starts))
    if not starts:
        return [[] for _ in bodies]
    bits = trees.code_lengths(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array(starts))
    picks = np.argmin(bits, axis=1)
    out: list[list[tuple[int, str, float, int, int]]] = []
    for i, body in enumerate(bodies):
        a, b = first[i], first[i + 1]
        if a == b:
            out.append([])
            continue
        if (picks[a:b] == picks[a]).all():
            out.append([(1, LANGUAGES[picks[a]], confidence(bits[a:b].sum(axis=0), int(picks[a])), 0, len(body))])
            continue
        way = path(bits[a:b])
        cuts = [k for k in range(1, b - a) if way[k] != way[k - 1]]
        spans = list(zip([0, *cuts], [*cuts, b - a], strict=True))
        base = starts[a]
        ends: list[int] = []
        if cuts:
            text = texts[i]
            ends = _offsets(masked(body), [len(text[: starts[a + k] - base].decode("utf-8", "replace").replace(" ", "")) for k in cuts])
        edges = [0, *ends, len(body)]
        out.append([(n + 1, LANGUAGES[way[x]], confidence(bits[a + x : a + y].sum(axis=0), way[x]), edges[n], edges[n + 1]) for n, (x, y) in enumerate(spans)])
    return out


def identify(rows: DataFrame, trees: Trees, step: int = 256) -> DataFrame:
    """(item_id, lang, body) -> (item_id, label, seg, lang, confidence, start, stop); label is the language lang names."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                out: list[tuple] = []
                ids, labels, bodies = (b.column(k).to_pylist() for k in range(3))
                for i, label, segs in zip(ids, labels, segments(trees, bodies), strict=True):
                    out += [(i, label, *s) for s in segs]
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "label", "seg", "lang", "confidence", "start", "stop"])

    named = rows.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), label_language(F.col("lang")).alias("label"), "body")
    return named.mapInArrow(run, "item_id long, label string, seg int, lang string, confidence double, start int, stop int").dropDuplicates(["item_id", "seg"])


def mislabelled(found: DataFrame) -> DataFrame:
    """Segments of the items whose label is missing or wrong, or that have several languages."""
    odd = found.where("seg > 1 OR label IS NULL OR (seg = 1 AND lang <> label)").select("item_id").distinct()
    return found.join(odd, "item_id", "left_semi")
