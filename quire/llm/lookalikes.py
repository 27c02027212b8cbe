"""Visually identical text with different characters (problem 10).

Most text is already canonical. A single character class, made of the code points whose normalization quick check
is not "yes" plus those folded here, finds the unstable segments; each is widened to a safe boundary (the starter
before it), normalized alone, and spliced into the unchanged text. Then look-alike letters are settled by word.

Canonical form: NFC; full- and half-width forms, no-break and ligature forms become the plain characters; every space
separator is U+0020; hyphens U+2010 and U+2011 are "-"; default-ignorable characters go, save joiners in scripts that
need them. Letters that look the same in Latin, Cyrillic and Greek take the script of the word's telling letters, or,
where a word has none, the script most telling letters of the text have. Superscripts, circled and styled forms look
different and stay. Case, digits, line breaks and wording stay. Null stays null, empty stays empty.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look the same, as Latin, Cyrillic, Greek. "-" where a script has none.
ALIKE = """
A А Α | B В Β | C С - | E Е Ε | H Н Η | I І Ι | J Ј - | K К Κ | M М Μ | N - Ν | O О Ο | P Р Ρ | S Ѕ -
T Т Τ | X Х Χ | Y У Υ | Z - Ζ | a а - | c с - | e е - | i і - | j ј - | o о ο | p р - | s ѕ - | x х - | y у - | h һ - | v - ν
"""
# Default-ignorable code points that show nothing, as ranges.
HIDDEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
HYPHENS = "‐‑"
FOLDED = ("<wide>", "<narrow>", "<noBreak>")


def _rows() -> list[tuple[str, ...]]:
    return [tuple(x.split()) for x in ALIKE.replace("\n", "|").split("|") if x.strip()]


@functools.cache
def _tables() -> tuple[re.Pattern, dict[int, str]]:
    """The class of unstable characters, and what single characters fold to."""
    fold: dict[int, str] = {ord(c): "-" for c in HYPHENS}
    for a, b in HIDDEN:
        fold |= dict.fromkeys(range(a, b + 1), "")
    unstable: list[int] = []
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]:
        if cp in fold:
            unstable.append(cp)
            continue
        c = chr(cp)
        way = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            fold[cp] = " "
        elif way.startswith(FOLDED) or (way.startswith("<compat>") and (0xFB00 <= cp <= 0xFB4F or 0x2160 <= cp <= 0x217F or cp in (0x132, 0x133, 0x2026) or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3)):
            fold[cp] = unicodedata.normalize("NFKC", c)
        elif not (unicodedata.combining(c) or (way and not way.startswith("<") and unicodedata.normalize("NFC", c) != c) or 0x1160 <= cp <= 0x11FF):
            continue
        unstable.append(cp)
    runs: list[list[int]] = []
    for cp in sorted(unstable):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    cls = "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in runs)
    return re.compile(f"[{cls}]+"), fold


@functools.cache
def _scripts() -> tuple[dict[str, str], tuple[dict[int, str], ...], tuple[re.Pattern, ...]]:
    """look-alike -> Latin stand-in; tables to each script; words of look-alikes alone, by script."""
    rows = _rows()
    stand_in = {c: r[0] for r in rows for c in r if c != "-"}
    to = tuple({ord(c): r[k] for r in rows if r[k] != "-" for c in r if c != "-"} for k in range(3))
    letters = [chr(cp) for cp in [*range(0x41, 0x530), *range(0x1E00, 0x2000)] if chr(cp).isalpha()]
    sets = ["".join(c for c in letters if _script(c) == k and unicodedata.normalize("NFD", c)[0] in stand_in) for k in range(3)]
    alone = tuple(re.compile(rf"[{x}](?<![^\W_].)(?<![̀-ͯ].)(?:[{x}]|[̀-ͯ])*(?![^\W_]|[̀-ͯ])", re.S) for x in sets)
    return stand_in, to, alone


WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
JOINERS = "\u200c\u200d\ufe0f"
#: Look-alikes that the main languages of their script do not use: a word of look-alikes alone is not put into them.
RARE = "ЅЈѕјһ"


def _script(c: str) -> int:
    cp = ord(c)
    if cp < 0x250 or 0x1E00 <= cp <= 0x1EFF:
        return 0
    if 0x400 <= cp <= 0x52F:
        return 1
    return 2 if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF else 3


def _joiner_matters(c: str) -> bool:
    cp = ord(c)
    return 0x590 <= cp <= 0x1CFF or 0xA800 <= cp <= 0xABFF or cp >= 0x1F000 or 0x2190 <= cp <= 0x2BFF


def _stable(s: str) -> str:
    """A segment in canonical form; it begins with a starter or at the start of the text."""
    _, fold = _tables()
    if any(c in s for c in JOINERS):
        s = "".join(c for i, c in enumerate(s) if c not in JOINERS or (i and _joiner_matters(s[i - 1])))
        return unicodedata.normalize("NFC", "".join(c if c in JOINERS else fold.get(ord(c), c) for c in s))
    return unicodedata.normalize("NFC", s.translate(fold))


def _splice(text: str) -> str:
    """Normalize the unstable segments, each with the character before it, and leave the rest as it is."""
    unstable, _ = _tables()
    out, done = [], 0
    for m in unstable.finditer(text):
        start = max(done, m.start() - 1)
        out += [text[done:start], _stable(text[start : m.end()])]
        done = m.end()
    # a fold may bring a starter next to marks that follow it: settle those few texts as a whole
    joined = "".join([*out, text[done:]])
    return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


@functools.cache
def _classes() -> np.ndarray:
    """By code point: 1-3 telling letters of Latin, Cyrillic, Greek; 4-6 their look-alikes; 7 unstable; 0 the rest."""
    stand_in = _scripts()[0]
    cls = np.zeros(0x110000, dtype=np.uint8)
    for cp in [*range(0x41, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(cp)
        if c.isalpha() and (k := _script(c)) < 3:
            cls[cp] = (4 if unicodedata.normalize("NFD", c)[0] in stand_in else 1) + k
    unstable, _ = _tables()
    for cp in range(0x80, 0x30000):
        if not 0xD800 <= cp < 0xE000 and unstable.match(chr(cp)):
            cls[cp] = 7
    return cls


SCRIPT_OF = np.array([0, 1, 2, 3, 1, 2, 3, 0], dtype=np.uint8)


def _settle(word: str, main: int) -> str:
    """A word in the script of its telling letters, or the first of the text's, Latin, Cyrillic, Greek that can write it."""
    stand_in, to, _ = _scripts()
    parts = unicodedata.normalize("NFD", word)
    telling = [0, 0, 0, 0]
    for c in parts:
        if c not in stand_in and not unicodedata.combining(c):
            telling[_script(c)] += 1
    best = max(telling[:3])
    if best:
        pick = main if telling[main] == best else telling.index(best)
    else:
        letters = {c for c in parts if c in stand_in}
        pick = next((k for k in (main, 0, 1, 2) if all(ord(c) in to[k] and to[k][ord(c)] not in RARE for c in letters)), 0)
    return unicodedata.normalize("NFC", parts.translate(to[pick]))


def canonical(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    cls = _classes()
    kinds = cls[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    n = np.bincount(kinds, minlength=8)
    if n[7]:
        text = _splice(text)
        if text.isascii():
            return text
        kinds = cls[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        n = np.bincount(kinds, minlength=8)
    main = int(np.argmax(n[1:4]))  # Latin, if the text has no telling letters
    if n[1:7].sum() == n[1 + main] + n[4 + main]:
        return text
    _, _, alone = _scripts()
    scripts = SCRIPT_OF[kinds]
    scripts = scripts[(scripts > 0) | (kinds != 7)]  # marks between letters don't part them
    if ((scripts[1:] != scripts[:-1]) & (scripts[1:] > 0) & (scripts[:-1] > 0)).any():
        text = WORD.sub(lambda m: m.group() if m.group().isascii() or not _mixed(m.group()) else _settle(m.group(), main), text)
    for k in range(3):
        if k != main and n[4 + k]:
            text = alone[k].sub(lambda m: _settle(m.group(), main), text)
    return text


def _mixed(word: str) -> bool:
    return len({_script(c) for c in word if not unicodedata.combining(c)} - {3}) > 1


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _canon_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def _look_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, looks, raws = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = _digest(t)
            c = canonical(t)
            ids.append(i)
            raws.append(raw)
            looks.append(raw if c is t or c == t else _digest(c))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=["doc_id", "look", "raw"])


def canonical_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the same rows with canonical text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_canon_batches, "doc_id long, text string")


def looks(docs: DataFrame) -> DataFrame:
    """(doc_id, look, raw): digests of the canonical and of the given text; no text leaves the workers."""
    return docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(_look_batches, "doc_id long, look binary, raw binary")


def alike_pairs(seen: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: same look, other characters.

    Works on classes of exact copies: classes of one look are paired first, and only those pairs are expanded to
    members, so a group of copies never meets itself.
    """
    classes = seen.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("look")
    several = seen.join(mixed, "look", "left_semi").distinct()
    forms = several.select("look", "raw").distinct()
    pairs = forms.select("look", F.col("raw").alias("ra")).join(forms.select("look", F.col("raw").alias("rb")), "look").where("ra < rb")
    a = several.select("look", F.col("raw").alias("ra"), F.col("doc_id").alias("x"))
    b = several.select("look", F.col("raw").alias("rb"), F.col("doc_id").alias("y"))
    both = pairs.join(a, ["look", "ra"]).join(b, ["look", "rb"])
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).where("doc_a < doc_b").distinct()
