"""Noise in text from scanned pages (problem 2).

1. Words of the whole collection are counted, with words broken over lines joined for the count.
2. Words that look alike to a scanner meet by their skeletons, in which glyphs that scanners mix up are the same, and
   are verified by an alignment. A word and a far more frequent one that turns into it make a possible link.
3. Skip-gram vectors with negative sampling: pairs of words within a window are counted over all texts (frequent words
   are subsampled by a hash, as the method does). Vectors of the ``CONTEXTS`` most frequent words as contexts are learned
   from their own counts by alternating Newton steps, a table bounded by the square of that number; with these every
   word of a possible link, rare or frequent, gets its own vector from all its counts, in the executors.
4. A link holds if the frequent word is a neighbour of the rare one in vector space. A word without a vector links to
   nothing.
5. Where a linked word stands in a text, the vectors of what is around it choose among its words, or leave it alone.
6. Furniture at the edges of a page is removed: page numbers, and running headers, which are like the work's title
   or recur at the edges of the source's pages (or, in such a source, are numbered as chapters are). Then words broken over lines are joined and lines flow into paragraphs.

Null or blank bodies have no damage and come out empty. A repeated row counts once in the result. Sources without a
title are judged by recurrence alone. Whole texts are read, every word is counted, and every word that is frequent
enough may be linked to. What was learned is broadcast if it is small (``SHARED_BYTES``); if not, every page gets its
own part of it by a join, with the same result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialise, maybe_broadcast

#: Words that serve as contexts: the most frequent ones.
CONTEXTS = 2_000
DIM = 24
WINDOW = 3
#: A context is thinned if it is more than this many times as frequent as contexts on average.
SUBSAMPLE = 0.06
#: Alternations between words and contexts, Newton steps in each, and the weight that keeps a vector of few counts short.
ALTERNATIONS = 5
STEPS = 4
SHRINK = 1.0
NEGATIVES = 4
#: How much more frequent a word is than its misreading, at least.
RATIO = 20
#: The least cosine of the vectors of a word and its misreading.
NEIGHBOUR = 0.15
#: The least gain of a word in its place: the mean log-ratio of its contexts beside it to chance.
FIT = -0.5
#: What was learned is broadcast up to this size.
SHARED_BYTES = 48 << 20

# Glyphs as printed and as scanners misread them.
CONFUSIONS = """
e c | o 0 | n ri | t f | l 1 | d cl | cl d | s 5 | i l | h b | u ii | w vv | m rn | g 9 | li h | rn m | b 6 | z 2 | i 1 | I l
о 0 | т m | н и | и н | с е | л п | ы ьl | п н | в 8 | м и | з 3 | ч 4 | г r | б 6 | ш ni | ш m | о o | а a | е c | і l | і 1
"""
HYPHENS = "-‐¬­"
BROKEN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][^\S\n]*\n[^\S\n]*(?=[^\W_])")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
HYPHEN = re.compile(r"[-‐](?P<line>[^\S\n]*\n[^\S\n]*)?(?=[^\W_])")
ENDS = re.compile(r"[.!?…:;,][\"'»”’)\]]*$")
STOPS = re.compile(r"[.!?…][\"'»”’)\]]*$")
FOLIO = re.compile(r"^[\[({<—–\-•|~*=·\s]*(?:(?:p|pp|page|pag|с|стр|s|seite)\.?\s*)?((?:[\dlIOoSB|]\s?){1,5}|[ivxlc]{1,8}|[IVXLC]{1,8})(?:\s*(?:of|/|из|von)\s*\d+)?[\])}>—–\-•|~*=·\s]*$", re.I)
GLUED_LEFT = re.compile(r"^\s*[\[(—–-]?\s*([\dlIO]{1,4}|[ivxlc]{1,7})\s*[\])—–-]?(?:\s*[•|·—–/]\s*|\s{2,}|\s(?=[^\W\d_]|\d{1,2}\.\s))")
GLUED_RIGHT = re.compile(r"(?:\s*[•|·—–/]\s*|\s+)[\[(—–-]?\s*([\dlIO]{1,4}|[ivxlc]{1,7})\s*[\])—–-]?\s*$")
CHAPTER = re.compile(r"^\s*[\dlIO]{1,3}\.\s+[^\W\d_]")
SECTION = re.compile(r"^\s*\d+\.\d+")
SIDES = re.compile(rf"([^\W_]+)([{HYPHENS}])[^\S\n]*\n[^\S\n]*([^\W_]+)")


def _pairs() -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in CONFUSIONS.replace("\n", "|").split("|") if x.strip()]


@functools.cache
def _edits() -> dict[str, list[tuple[str, str]]]:
    """Confusions by the first glyph as misread."""
    out: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for good, bad in _pairs():
        out[bad[0]].append((good, bad))
    return out


@functools.cache
def _folding() -> tuple[dict[str, str], dict[int, str]]:
    """What pairs of glyphs and single glyphs become in a skeleton."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for good, bad in _pairs():
        a, b = find(good.lower()), find(bad.lower())
        if a != b:
            keep, lose = sorted((a, b), key=lambda x: (len(x), x.isdigit(), not x.isascii(), x))
            root[lose] = keep
    return {x: find(x) for x in sorted(root) if len(x) > 1}, {ord(x): find(x) for x in root if len(x) == 1}


def skeleton(word: str) -> str:
    """The word with single confusable glyphs alike."""
    return word.translate(_folding()[1])


def skeletons(word: str) -> set[str]:
    """Skeletons with no pair of glyphs folded, each kind of pair alone, and all in two orders.

    A word and its misreading share one if a single kind of pair was misread, whatever single glyphs were.
    """
    pairs, _ = _folding()
    here = [p for p in pairs if p in word]
    out = {skeleton(word), *(skeleton(word.replace(p, pairs[p])) for p in here)}
    for order in (here, here[::-1]) if len(here) > 1 else ():
        w = word
        for p in order:
            w = w.replace(p, pairs[p])
        out.add(skeleton(w))
    return out


def plausible(good: str, bad: str, most: int = 3) -> bool:
    """Whether ``bad`` is ``good`` with one to ``most`` glyphs misread."""
    edits = _edits()
    states = {(0, 0): 0}
    for _ in range(len(good) + len(bad) + 1):
        nxt: dict[tuple[int, int], int] = {}
        for (i, j), n in states.items():
            if i == len(good) and j == len(bad):
                return n > 0
            if i < len(good) and j < len(bad) and good[i] == bad[j]:
                nxt[i + 1, j + 1] = min(n, nxt.get((i + 1, j + 1), 99))
            if n < most and j < len(bad):
                for g, b in edits.get(bad[j], ()):
                    if good.startswith(g, i) and bad.startswith(b, j):
                        at = (i + len(g), j + len(b))
                        nxt[at] = min(n + 1, nxt.get(at, 99))
        states = nxt
    return False


def joined(body: str) -> str:
    """The text with words broken over lines joined."""
    return BROKEN.sub("", body) if "\n" in body else body


def words_of(body: str) -> list[str]:
    return TOKEN.findall(joined(body).lower())


# ---- edges of pages -------------------------------------------------------------------------------------------------


def line_key(line: str) -> str:
    """The letters of a line with confusable glyphs alike, without a page number at either end."""
    bare = GLUED_RIGHT.sub("", GLUED_LEFT.sub("", line))
    return "".join(c for c in skeleton(bare.lower()) if c.isalpha())


def edge_lines(lines: list[str]) -> list[list[int]]:
    """Numbers of the lines that may be furniture by their place, from each edge inwards."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    if len(full) < 2:
        return []
    top = full[: min(3, len(full) - 1)]
    return [top, [i for i in full[: -1 - min(3, len(full) - 1) : -1] if i not in top[:1]]]


def _number(text: str) -> str | None:
    """The page number that a whole line is, as printed, or None."""
    m = FOLIO.match(text)
    if not m:
        return None
    token = m.group(1).replace(" ", "")
    if any(c.isdigit() for c in token) or re.fullmatch(r"[ivxlc]+|[IVXLC]+", token) or token in ("l", "I", "O", "lO", "ll", "|", "l|"):
        return token
    return None


def headed(line: str) -> bool:
    """Whether a line looks like a head of a chapter: numbered on one level, or all capitals."""
    bare = GLUED_LEFT.sub("", line)
    if SECTION.match(bare) or len(line) > 110 or ENDS.search(line.strip()):
        return False
    letters = [c for c in bare if c.isalpha()]
    return bool(CHAPTER.match(bare)) or len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.9 * len(letters)


# Latin spellings of Cyrillic letters, as file names have them.
LATIN = dict(zip("абвгдеёзийклмнопрстуфыэі", "a b v g d e e z i y k l m n o p r s t u f y e i".split(), strict=True)) | dict(
    zip("жхцчшщъьюя", ("zh", "kh", "ts", "ch", "sh", "shch", "", "", "yu", "ya"), strict=True)
)


def latin_key(line: str) -> str:
    bare = GLUED_RIGHT.sub("", GLUED_LEFT.sub("", line)).lower()
    return skeleton("".join(LATIN.get(c, c) for c in bare if c.isalpha()))


def _alike(a: str, b: str) -> float:
    """Share of the letter trigrams of ``a`` that ``b`` has."""
    grams = {a[i : i + 3] for i in range(len(a) - 2)}
    return sum(g in b for g in grams) / len(grams) if grams else 0.0


class Page:
    """What stands at the edges of a page."""

    def __init__(self, body: str, title_key: str, recurring: set[str], headed_source: bool):
        self.lines = body.split("\n")
        self.headed_source = headed_source
        self.drop: set[int] = set()
        self.header = self.folio = self.misread = False
        for side in edge_lines(self.lines):
            for i in side:
                if i in self.drop or not self._furniture(i, title_key, recurring):
                    break

    def _furniture(self, i: int, title_key: str, recurring: set[str]) -> bool:
        text = self.lines[i].strip()
        number = _number(text)
        if number is not None:
            self.folio = True
            self.drop.add(i)
            self.misread |= any(c.isdigit() for c in number) and any(c.isalpha() or c == "|" for c in number)
            return True
        if len(text) > 130 or SECTION.match(text):
            return False
        key = line_key(text)
        if len(key) < 4:
            return False
        near = title_key and (key == title_key or len(key) >= 10 and (_alike(key, title_key) >= 0.75 or len(title_key) >= 12 and _alike(title_key, key) >= 0.85 or not key.isascii() and title_key.isascii() and _alike(latin_key(text), title_key) >= 0.6))
        if ENDS.search(text) and not near:
            return False
        # a chapter's head that is printed once counts in a source that has running heads
        if not near and not (headed(text) and (key in recurring or self.headed_source and CHAPTER.match(GLUED_LEFT.sub("", text)))):
            return False
        self.header = True
        self.drop.add(i)
        for m in (GLUED_LEFT.match(text), GLUED_RIGHT.search(text)):
            if m and (any(c.isdigit() for c in m.group(1)) or re.fullmatch(r"[ivxlc]{1,7}|[lIO]{1,2}", m.group(1))):
                self.folio = True
                self.misread |= any(c.isdigit() for c in m.group(1)) and any(c.isalpha() for c in m.group(1))
        return True


# ---- learning -------------------------------------------------------------------------------------------------------


def edge_keys(lines: list[str]) -> set[str]:
    """Keys of the lines at the edges of a page that look like heads."""
    return {key for i in {i for side in edge_lines(lines) for i in side[:2]} if headed(lines[i]) and len(key := line_key(lines[i])) >= 4}


def hyphened(body: str) -> tuple[list[str], list[str]]:
    """Words with a hyphen, as ``left-right``: those within a line, and those broken over lines."""
    inner, broken = [], []
    for m in HYPHEN.finditer(body):
        i, j = m.start(), m.end()
        while i and body[i - 1].isalnum():
            i -= 1
        while j < len(body) and body[j].isalnum():
            j += 1
        if i < m.start():
            (inner if m["line"] is None else broken).append(f"{body[i : m.start()]}-{body[m.end() : j]}".lower())
    return inner, broken


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: counts of words (kind w), of words with an inner hyphen (c) and broken ones (b); keys of heads at edges (e)."""
    words, inner, broken = Counter(), Counter(), Counter()
    edges: dict[tuple[int, str], tuple[int, int]] = {}
    for b in batches:
        for chunk, source, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            words.update(words_of(body))
            if "-" in body or "‐" in body:
                for counter, found in zip((inner, broken), hyphened(body), strict=True):
                    counter.update(found)
            for key in edge_keys(body.split("\n")):
                lo, hi = edges.get((source, key), (chunk, chunk))
                edges[source, key] = (min(lo, chunk), max(hi, chunk))
        if len(words) > 400_000:
            yield _rows({"w": words, "c": inner, "b": broken}, edges)
            words, inner, broken, edges = Counter(), Counter(), Counter(), {}
    yield _rows({"w": words, "c": inner, "b": broken}, edges)


def _rows(held: dict[str, Counter], edges: dict) -> pa.RecordBatch:
    n, m = sum(map(len, held.values())), len(edges)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, c in held.items() for _ in c] + ["e"] * m, pa.string()), pa.array([None] * n + [s for s, _ in edges], pa.int64()), pa.array([*(w for c in held.values() for w in c), *(k for _, k in edges)], pa.string()),
            pa.array([*(x for c in held.values() for x in c.values()), *([0] * m)], pa.int64()), pa.array([None] * n + [lo for lo, _ in edges.values()], pa.int64()), pa.array([None] * n + [hi for _, hi in edges.values()], pa.int64()),
        ],
        names=["kind", "source", "x", "n", "lo", "hi"],
    )


def _skeletal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(w) >= 2:
                good = n >= RATIO and not any(c.isdigit() for c in w[:-1])
                out += [(k, w, n, good, not w.isdigit()) for k in skeletons(w)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["key", "w", "n", "good", "bad"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([plausible(g, w) for w, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_()))


def possible_links(words: DataFrame) -> DataFrame:
    """(x, n) of all words -> (bad, good, n_good): words that glyph edits make of words at least ``RATIO`` times as frequent."""
    keyed = words.select("x", "n").mapInArrow(_skeletal, "key string, w string, n long, good boolean, bad boolean")
    bad, good = keyed.where("bad").select("key", F.col("w").alias("bad"), F.col("n").alias("n_bad")), keyed.where("good").select("key", F.col("w").alias("good"), F.col("n").alias("n_good"))
    enough = F.col("n_good") >= RATIO * F.col("n_bad") * F.when(F.length("bad") == 2, 10).otherwise(1)
    return bad.join(good, "key").where(enough & (F.col("bad") != F.col("good"))).select("bad", "good", "n_good").distinct().mapInArrow(_verified, "bad string, good string, n_good long")


def _pair_counter(contexts: dict[str, int], keep: np.ndarray, centres: set[str] | None):
    """Counts pairs of a centre word and a context within the window; rows (w, c, n).

    Contexts, the frequent words, are centres too, and frequent ones are left out by a hash of their place; of other
    centres, which are rare, all neighbours count. ``centres`` None: every word is one.
    """
    size = len(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = dict(contexts)
        if centres is not None:
            for w in centres:
                code.setdefault(w, len(code))
        held: list[np.ndarray] = []
        for b in batches:
            seq: list[np.ndarray] = []
            place: list[np.ndarray] = []
            for body in b.column(0).to_pylist():
                words = words_of(body)
                seq.append(np.array([code.get(w, -1) for w in words] if centres is not None else [code.setdefault(w, len(code)) for w in words], dtype=np.int64))
                place.append(np.arange(len(words), dtype=np.uint64) + np.uint64(len(body)))
                seq.append(np.full(WINDOW, -2)), place.append(np.zeros(WINDOW, dtype=np.uint64))
            if not seq:
                continue
            a, at = np.concatenate(seq), np.concatenate(place)
            draw = (at * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) / (1 << 24)
            frequent = (a >= 0) & (a < size)
            thin = a[(a == -2) | (frequent & (draw < keep[np.where(frequent, a, 0)]))] if size else a[:0]
            for d in range(1, WINDOW + 1):
                x, y = thin[:-d], thin[d:]
                ok = (x >= 0) & (y >= 0)
                held += [x[ok] * size + y[ok], y[ok] * size + x[ok]]
                for x, y in ((a[:-d], a[d:]), (a[d:], a[:-d])):
                    ok = (x >= size) & (y >= 0) & (y < size)
                    held.append(x[ok] * size + y[ok])
            if sum(map(len, held)) > 4_000_000:
                yield counted(held, code)
                held = []
        yield counted(held, code)

    def counted(held: list[np.ndarray], code: dict[str, int]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.int64), return_counts=True)
        words = pa.array(list(code), pa.string())
        return pa.RecordBatch.from_arrays([words.take(pa.array(pair // max(1, size))), pa.array(pair % max(1, size), pa.int32()), pa.array(n, pa.int64())], names=["w", "c", "n"])

    return run


def newton(counts: np.ndarray, other: np.ndarray, noise: np.ndarray, begin: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """For rows of counts over contexts, the vectors that maximise the skip-gram objective, given the contexts' vectors.

    Of every row: sum of n log s(u v) + NEGATIVES (row's total) noise log s(-u v), less SHRINK u u / 2.
    """
    dim = other.shape[1]
    other = other.astype(np.float32)
    u = np.zeros((len(counts), dim), dtype=np.float32) if begin is None else begin
    both = (counts + NEGATIVES * counts.sum(axis=1, keepdims=True) * noise).astype(np.float32)
    upper = np.triu_indices(dim)
    square = other[:, upper[0]] * other[:, upper[1]]
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(u @ other.T, -30, 30)))
        slope = (counts - both * s) @ other - SHRINK * u
        bend = np.empty((len(u), dim, dim))
        bend[:, upper[0], upper[1]] = bend[:, upper[1], upper[0]] = (both * s * (1 - s)) @ square
        step = np.linalg.solve(bend + SHRINK * np.eye(dim), slope[:, :, None])[:, :, 0]
        u = (u + step * np.minimum(1.0, 2 / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-9))).astype(np.float32)
    return u


def skip_gram(counts: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of contexts, noise distribution) from the square table of counts among contexts."""
    noise = counts.sum(axis=0) ** 0.75
    noise = noise / max(noise.sum(), 1e-9)
    v = np.random.default_rng(seed).normal(scale=0.5, size=(len(counts), DIM)).astype(np.float32)
    u = np.zeros_like(v)
    for at in range(2 * ALTERNATIONS if len(counts) else 0):  # words and contexts have the same counts, so the sides only change places
        steps = STEPS if at < 2 else 1  # later ones start from where the side was
        u, v = v, np.concatenate([newton(counts[i : i + 128], v, noise, u[i : i + 128] if at >= 2 else None, steps) for i in range(0, len(counts), 128)])
    return v, noise


def _train(size: int):
    """All of the square table (at most CONTEXTS ** 2 rows) in one task -> the contexts' vectors and noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, size), dtype=np.float32)
        for b in batches:
            table[b.column(0).to_numpy(), b.column(1).to_numpy()] = b.column(2).to_numpy()
        v, noise = skip_gram(table)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in v], pa.binary()), pa.array(noise, pa.float64())], names=["c", "v", "noise"])

    return run


def _place(v: np.ndarray, noise: np.ndarray):
    """Counts of a word over contexts -> its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                counts = np.zeros((part.num_rows, len(v)))
                for i, near in enumerate(part.column(1).to_pylist()):
                    for x in near:
                        counts[i, x["c"]] = x["n"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in newton(counts, v, noise)], pa.binary())], names=["w", "u"])

    return run


def gain(mean: np.ndarray, u: np.ndarray) -> float:
    """How much likelier contexts are beside a word than by chance: the mean log-ratio, which vectors of this kind approximate."""
    return float(mean @ u) + math.log(NEGATIVES)


def neighbours(u_bad: np.ndarray, u_good: np.ndarray, least: float = NEIGHBOUR) -> bool:
    """Whether a frequent word is a neighbour of a rare one in vector space; vectors of zeros have no neighbours."""
    length = float(np.linalg.norm(u_bad) * np.linalg.norm(u_good))
    return length > 0 and float(u_bad @ u_good) >= least * length


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, good = ([np.frombuffer(x, dtype=np.float32) for x in b.column(k).to_pylist()] for k in ("u_bad", "u"))
            yield b.select(["bad", "good", "u"]).filter(pa.array([neighbours(x, y, least) for x, y in zip(bad, good, strict=True)], pa.bool_()))

    return run


class Lexicon:
    """What workers need besides a page: the contexts' vectors, and for words in doubt the words they are linked to.

    ``links``: misread word -> [(word, vector)]; ``compounds``: broken words whose hyphen stays.
    """

    def __init__(self, ids: dict[str, int], v: np.ndarray, links: dict[str, list[tuple[str, np.ndarray]]] | None = None, compounds: set[str] | None = None):
        self.ids, self.v, self.links, self.compounds = ids, v, links or {}, compounds or set()
        self.least = FIT

    def fit(self, word: str, around: list[str]) -> str | None:
        """The linked word that best fits its neighbours, if any fits; where no neighbour is known, the first linked word."""
        ctx = [self.ids[w] for w in around if w in self.ids]
        best, at = None, self.least
        mean = self.v[ctx].mean(axis=0) if ctx else None
        for w, u in self.links[word]:
            s = gain(mean, u) if mean is not None else 0.0
            if s > at:
                best, at = w, s
        return best


class Learned:
    """Tables of what was learned: links (bad, good, u), compounds (x), heads (source_id, x); and the contexts."""

    def __init__(self, ids: dict[str, int], v: np.ndarray, links: DataFrame, compounds: DataFrame, heads: DataFrame):
        self.ids, self.v, self.links, self.compounds, self.heads = ids, v, links, compounds, heads


def learn(chunks: DataFrame) -> Learned:
    """(item_id, source_id, body) of all pages -> links of misread words, compounds, and heads that recur in a source."""
    pages = chunks.where("body IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("source_id").cast("long"), "body")
    found = pages.mapInArrow(_gather, "kind string, source long, x string, n long, lo long, hi long").groupBy("kind", "source", "x")
    seen = materialise(found.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "words")
    words = seen.where("kind = 'w'").select("x", "n")
    maybe = materialise(possible_links(words), "possible")
    top = words.join(maybe.select(F.col("bad").alias("x")), "x", "left_anti").where("n >= 5").orderBy(F.desc("n"), "x").limit(CONTEXTS).collect()  # bounded
    ids = {r.x: i for i, r in enumerate(top)}
    counts = np.array([r.n for r in top] or [1])
    keep = np.minimum(1.0, np.sqrt(SUBSAMPLE * counts.mean() / counts))
    wanted = maybe.select(F.explode(F.array("bad", "good")).alias("w")).distinct()
    centres = {r.w for r in wanted.collect()} if _small(wanted, F.length("w") + 60) else None
    pairs = materialise(pages.select("body").mapInArrow(_pair_counter(ids, keep, centres), "w string, c int, n long").groupBy("w", "c").agg(F.sum("n").alias("n")), "near")
    v, noise = np.zeros((len(ids), DIM), dtype=np.float32), np.zeros(len(ids))
    if ids:
        codes = chunks.sparkSession.createDataFrame([(r.x, i) for i, r in enumerate(top)], "w string, i int")
        square = pairs.join(F.broadcast(codes), "w").select("i", "c", "n").coalesce(1)  # CONTEXTS ** 2 rows at most
        for r in square.mapInArrow(_train(len(ids)), "c int, v binary, noise double").collect():
            v[r.c], noise[r.c] = np.frombuffer(r.v, dtype=np.float32), r.noise
    lists = pairs.join(wanted, "w", "left_semi").groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("near"))  # CONTEXTS entries at most
    vectors = materialise(lists.mapInArrow(_place(v, noise), "w string, u binary"), "vectors")
    both = maybe.join(vectors.select(F.col("w").alias("bad"), F.col("u").alias("u_bad")), "bad").join(vectors.select(F.col("w").alias("good"), "u"), "good")
    links = materialise(both.select("bad", "good", "u", "u_bad").mapInArrow(_linked(NEIGHBOUR), "bad string, good string, u binary"), "links")
    # a hyphen at a line's end stays if the word stands with it within lines, at least as often as in one piece elsewhere
    broken = seen.where("kind = 'b'").select("x", F.col("n").alias("n_broken"), F.regexp_replace("x", "-", "").alias("whole"))
    inner = seen.where("kind = 'c'").select("x", F.col("n").alias("n_inner"))
    compounds = broken.join(inner, "x").join(words.select(F.col("x").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").where("n_inner >= coalesce(n_whole, 0) - n_broken").select("x")
    heads = seen.where("kind = 'e' AND lo < hi").select(F.col("source").alias("source_id"), "x")
    return Learned(ids, v, links, materialise(compounds, "compounds"), heads)


def _small(df: DataFrame, width: Column) -> bool:
    return (df.agg(F.sum(width)).first()[0] or 0) <= SHARED_BYTES


# ---- repair ---------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=5000)
def title_key(title: str | None) -> str:
    """Letters of a title as files have it, skeletal; without decoration after a colon or in brackets."""
    if not title:
        return ""
    plain = re.sub(r"[_.]+", " ", title).replace("-", " ") if " " not in title else title
    return "".join(c for c in skeleton(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", plain).lower()) if c.isalpha())




def repair(body: str, title: str | None, keys: set[str], lex: Lexicon, rewrite: bool = False, headed_source: bool = False) -> tuple[list[str], str]:
    """The sorts of damage of a page, and (if wanted) its clean text.

    ``keys``: heads that recur in its source, at least those that the page has; ``headed_source``: the source has any.
    """
    page = Page(body, title_key(title), keys, headed_source or bool(keys))
    found = {"header": page.header, "folio": page.folio, "misread": page.misread, "hyphen": False}
    inner = "\n".join(x for i, x in enumerate(page.lines) if i not in page.drop)

    def mend(m: re.Match) -> str:
        if m.group(2) in "-‐" and f"{m.group(1)}-{m.group(3)}".lower() in lex.compounds:
            return m.group(1) + "-" + m.group(3)
        found["hyphen"] = True
        return m.group(1) + m.group(3)

    whole = inner
    if any(h + "\n" in inner or h + " \n" in inner for h in HYPHENS):
        whole = SIDES.sub(mend, SIDES.sub(mend, inner))
    heads = " ".join(page.lines[i] for i in sorted(page.drop))
    text = whole if rewrite else f"{whole}\n{heads}"
    tokens = TOKEN.findall(text)
    low = [t.lower() for t in tokens]
    fixes: dict[int, str] = {}
    for i in (i for i, t in enumerate(low) if t in lex.links):
        best = lex.fit(low[i], low[max(0, i - WINDOW) : i] + low[i + 1 : i + 1 + WINDOW])
        if best:
            found["misread"] = True
            if not rewrite:
                break
            fixes[i] = best
    if rewrite:
        if not found["misread"] and heads:
            found["misread"] = "misread" in repair(body, title, keys, lex, False, headed_source)[0]
        at = iter(range(len(tokens)))

        def put(m: re.Match) -> str:
            fix = fixes.get(next(at))
            if fix is None:
                return m.group()
            return fix.upper() if m.group().isupper() and len(fix) > 1 else fix.capitalize() if m.group()[:1].isupper() else fix

        whole = reflow(TOKEN.sub(put, whole))
    return sorted(k for k, x in found.items() if x), whole if rewrite else ""


def _prose(line: str) -> bool:
    letters = sum(c.isalpha() for c in line)
    return letters >= 0.5 * max(1, len(line.replace(" ", "")))


def reflow(text: str) -> str:
    """Lines of prose flow into paragraphs; blank lines part them unless a sentence runs on; other lines stay."""
    out: list[str] = []
    new = True
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            new = new or not out or bool(STOPS.search(out[-1])) or not _prose(out[-1])
            continue
        runs_on = out and not new and _prose(line) and _prose(out[-1]) and not SECTION.match(line)
        if runs_on or (out and not new and line[:1].islower()):
            out[-1] += " " + line
        else:
            out.append(line)
        new = False
    return "\n\n".join(out)


def _own_links(rows: list[dict] | None, lex: Lexicon) -> tuple[Lexicon, set[str]]:
    """The part of the lexicon that came with a page."""
    links: dict[str, list[tuple[str, np.ndarray]]] = defaultdict(list)
    compounds, keys = set(), set()
    for r in sorted(rows or (), key=lambda r: (r["kind"], r["x"], r["good"] or "")):
        if r["kind"] == "w":
            links[r["x"]].append((r["good"], np.frombuffer(r["u"], dtype=np.float32)))
        else:
            (compounds if r["kind"] == "b" else keys).add(r["x"])
    own = Lexicon(lex.ids, lex.v, links, compounds)
    own.least = lex.least
    return own, keys


def _mapper(shared, rewrite: bool):
    """Rows (item_id, body, title, source_id, headed, own): own is the page's part of what was learned, or null where ``shared`` has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, heads = shared.value
        for b in batches:
            ids, kinds, texts = [], [], []
            for i, body, title, source, headed_source, own in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if not body or not body.strip():
                    if rewrite:
                        ids.append(i), kinds.append([]), texts.append("")
                    continue
                lex, keys = (whole, heads.get(source, set())) if heads is not None else _own_links(own, whole)
                damage, clean = repair(body, title, keys, lex, rewrite, bool(headed_source))
                if rewrite:
                    ids.append(i), kinds.append(damage), texts.append(clean)
                else:
                    ids += [i] * len(damage)
                    kinds += damage
            if rewrite:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["item_id", "damage", "text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["item_id", "damage"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What of a page may be in the learned tables: (item_id, source_id, kind, x)."""
    for b in batches:
        out = []
        for item, source, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            text = joined(body)
            out += [(item, None, "w", w) for w in {w.lower() for w in TOKEN.findall(text)} | {w.lower() for w in TOKEN.findall(body)}]
            out += [(item, None, "b", x) for x in set(hyphened(body)[1])]
            out += [(item, source, "e", x) for x in edge_keys(body.split("\n"))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["item_id", "source_id", "kind", "x"])


def pages(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of books and papers: (item_id, source_id, body)."""
    files = sources.where(F.col("kind").isin("book", "paper")).select("source_id")
    return chunks.select(F.col("chunk_id").alias("item_id"), "source_id", "body").join(maybe_broadcast(files), "source_id")


def damage(all_pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, damage): one row per page and sort of damage."""
    return _apply(all_pages, sources, False, "item_id long, damage string").distinct()


def clean(all_pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, damage, text): pages as continuous paragraphs."""
    return _apply(all_pages, sources, True, "item_id long, damage array<string>, text string").dropDuplicates(["item_id"])


def _own_parts(pages: DataFrame, got: Learned) -> DataFrame:
    """(item_id, own): for every page the links, compounds and heads that it holds; as many as it has words at most."""
    facts = (
        got.links.select(F.lit("w").alias("kind"), F.lit(None).cast("long").alias("s"), F.col("bad").alias("x"), "good", "u")
        .unionByName(got.compounds.select(F.lit("b").alias("kind"), F.lit(None).cast("long").alias("s"), "x", F.lit(None).cast("string").alias("good"), F.lit(None).cast("binary").alias("u")))
        .unionByName(got.heads.select(F.lit("e").alias("kind"), F.col("source_id").alias("s"), "x", F.lit(None).cast("string").alias("good"), F.lit(None).cast("binary").alias("u")))
    )
    marks = pages.where("item_id IS NOT NULL AND body IS NOT NULL").select(F.col("item_id").cast("long"), F.col("source_id").cast("long"), "body").mapInArrow(_marks, "item_id long, source_id long, kind string, x string").distinct()
    met = marks.alias("m").join(facts.alias("f"), (F.col("m.kind") == F.col("f.kind")) & (F.col("m.x") == F.col("f.x")) & F.col("m.source_id").eqNullSafe(F.col("f.s")))
    return met.groupBy("m.item_id").agg(F.collect_set(F.struct(F.col("f.kind").alias("kind"), F.col("f.x").alias("x"), "f.good", "f.u")).alias("own"))


def _apply(all_pages: DataFrame, sources: DataFrame, rewrite: bool, schema: str) -> DataFrame:
    spark = all_pages.sparkSession
    got = learn(all_pages)
    small = _small(got.links, F.length("bad") + 2 * F.length("good") + 4 * DIM) and _small(got.compounds, F.length("x") + 60) and _small(got.heads, F.length("x") + 120)
    lex, heads = Lexicon(got.ids, got.v), None
    if small:
        vectors: dict[str, np.ndarray] = {}
        links: dict[str, list[tuple[str, np.ndarray]]] = defaultdict(list)
        for r in sorted(got.links.collect(), key=lambda r: (r.bad, r.good)):
            links[r.bad].append((r.good, vectors.setdefault(r.good, np.frombuffer(r.u, dtype=np.float32))))
        lex = Lexicon(got.ids, got.v, dict(links), {r.x for r in got.compounds.collect()})
        heads = {}
        for r in got.heads.collect():
            heads.setdefault(r.source_id, set()).add(r.x)
    shared = spark.sparkContext.broadcast((lex, heads))  # SHARED_BYTES and the contexts' vectors at most
    has = got.heads.select("source_id").distinct().withColumn("headed", F.lit(True))
    about = sources.select(F.col("source_id").cast("long"), "title").join(has, "source_id", "full").groupBy("source_id").agg(F.max("title").alias("title"), F.max("headed").alias("headed"))
    rows = all_pages.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("source_id").cast("long"), "body").join(maybe_broadcast(about), "source_id", "left")
    own = F.lit(None).cast("array<struct<kind:string,x:string,good:string,u:binary>>")
    rows = rows.withColumn("own", own) if small else rows.join(_own_parts(all_pages, got), "item_id", "left")
    return rows.select("item_id", "body", "title", "source_id", "headed", "own").mapInArrow(_mapper(shared, rewrite), schema)
