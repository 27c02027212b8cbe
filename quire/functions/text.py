"""Column functions over page text, titles and identifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PAGE_BYTES = 150
# Thresholds of the page rules.
LEADER_SHARE, INDEX_SHARE, INDEX_LINES = 0.3, 0.5, 10
FOREIGN_SHARE, VOWEL_SHARE, SHIFTED_SHARE, MIN_CHARS, SHIFT = 0.3, 0.12, 0.25, 50, 29
VOWELS = "aeiouyаеёиоуыэюя"
RUSSIAN_SHARE = 0.25


def kept(c: Column, cls: str) -> Column:
    """How many characters of a class there are."""
    return F.length(F.regexp_replace(c, f"[^{cls}]+", ""))


def vowels(c: Column) -> Column:
    """How many vowels of the two alphabets; deleting them is far quicker than a pattern for what lies between."""
    low = F.lower(c)
    return F.length(low) - F.length(F.translate(low, VOWELS, ""))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used (conditions are not shared otherwise)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def language(c: Column) -> Column:
    """``russian`` if a quarter of the Latin and Cyrillic letters is Cyrillic, else ``english``."""
    cyr, lat = kept(c, r"\p{IsCyrillic}"), kept(c, r"\p{IsLatin}")
    return F.when((cyr > 0) & (cyr / (cyr + lat) >= RUSSIAN_SHARE), "russian").otherwise("english")


def too_short(c: Column) -> Column:
    """Fewer than 150 bytes once stripped."""
    return F.octet_length(strip(c)) < MIN_PAGE_BYTES


def _lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n", -1), lambda x: strip(x) != "")


LEADERS = r"\.\s?\.\s?\.\s?\."
ENTRY = r"^\s*\S.*,\s*\d+(\s*[,–-]\s*\d+)*\s*$"


def line_counts(c: Column) -> Column:
    """n_lines that are not blank, leaders and entries among them, as a struct."""
    return once(_lines(c), lambda ls: F.struct(F.size(ls).alias("n_lines"), F.size(F.filter(ls, lambda x: x.rlike(LEADERS))).alias("leaders"), F.size(F.filter(ls, lambda x: x.rlike(ENTRY))).alias("entries")))


def matter(n: Column) -> Column:
    """Contents pages and subject indexes, by their line counts."""
    return (n.leaders > n.n_lines * LEADER_SHARE) | ((n.n_lines > INDEX_LINES) & (n.entries > n.n_lines * INDEX_SHARE))


def front_or_back(c: Column) -> Column:
    """Contents pages, subject indexes, dividers."""
    return too_short(c) | once(line_counts(c), matter)


def _shifted(c: Column) -> Column:
    """ASCII moved up by the glyph order; a character that becomes a space or digit, or is one, is left out of counts."""
    low = "".join(map(chr, range(1, 127)))
    return F.translate(c, low, "".join(chr(ord(x) + SHIFT) for x in low))


def char_counts(c: Column) -> Column:
    """letters, foreign, chars, vowels, and chars and vowels of the shifted text, as a struct."""
    solid = lambda x: F.length(F.regexp_replace(x, r"(?U)[\s\p{Nd}]+", ""))
    plain = once(
        kept(c, r"\p{L}"),
        lambda n: F.struct(n.alias("letters"), (n - kept(c, "a-zA-Z") - kept(c, r"\p{IsCyrillic}&&\p{L}")).alias("foreign"), solid(c).alias("chars"), vowels(c).alias("vowels")),
    )
    moved = once(_shifted(c), lambda m: F.struct(solid(m).alias("shifted_chars"), vowels(m).alias("shifted_vowels")))
    return once(F.struct(plain.alias("p"), moved.alias("m")), lambda x: F.struct(*[x.p[k].alias(k) for k in ("letters", "foreign", "chars", "vowels")], *[x.m[k].alias(k) for k in ("shifted_chars", "shifted_vowels")]))


def garbled(n: Column) -> Column:
    """Foreign letters, a layer without vowels, or one that reads only when its ASCII is moved back up; by its counts."""
    return (
        ((n.letters >= MIN_CHARS) & (n.foreign > n.letters * FOREIGN_SHARE))
        | ((n.chars >= MIN_CHARS) & (n.vowels < n.chars * VOWEL_SHARE))
        | ((n.shifted_chars >= MIN_CHARS) & (n.shifted_vowels > n.shifted_chars * SHIFTED_SHARE) & (n.shifted_vowels * n.chars > n.vowels * n.shifted_chars))
    )


def unreadable(c: Column) -> Column:
    return once(char_counts(c), garbled)


def normalize_title(c: Column) -> Column:
    """Lower case, ё as е, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[^\p{L}\p{Nd}]+", " "))


def find_doi(c: Column, least: int = 4) -> Column:
    """The first DOI, without punctuation after it; null if its suffix has fewer than ``least`` bytes."""
    doi = F.regexp_replace(F.regexp_extract(c, r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)\]]+$", "")
    return F.when((doi != "") & (F.octet_length(F.regexp_replace(doi, r"^[^/]*/", "")) >= least), doi)


def find_arxiv(c: Column) -> Column:
    got = F.lower(F.regexp_extract(c, r"(?i)arxiv[:/\s]\s*(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+(\.[A-Z]{2})?/\d{7})", 1))
    return F.when(got != "", got)


def isbn_candidates(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"ISBN(?:-1[03])?[:\s]*((?:97[89][\s-]?)?(?:\d[\s-]?){9}[\dXx])"), F.lit(1))
    return F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"[^\dXx]", "")))


def valid_isbn(c: Column) -> Column:
    """Check digit of ten or thirteen digits."""
    digits = F.transform(F.split(c, ""), lambda x: F.when(x == "X", 10).otherwise(x.cast("int")))
    ten = F.aggregate(F.transform(digits, lambda d, i: d * (F.lit(10) - i)), F.lit(0), lambda a, b: a + b) % 11 == 0
    thirteen = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, b: a + b) % 10 == 0
    return F.coalesce(F.when(c.rlike(r"^\d{9}[\dX]$"), ten).when(c.rlike(r"^\d{13}$"), thirteen).otherwise(F.lit(False)), F.lit(False))


def first_isbn(c: Column) -> Column:
    return F.get(F.filter(isbn_candidates(c), valid_isbn), F.lit(0))


def fingerprint(doi: Column, arxiv: Column, isbn: Column, title: Column, year: Column, raw: Column) -> Column:
    """One key for one cited work: DOI, arXiv id, ISBN, title and year, or the line itself."""
    some = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(some(doi), F.lower(doi))
        .when(some(arxiv), F.concat(F.lit("arxiv:"), arxiv))
        .when(some(isbn), F.concat(F.lit("isbn:"), isbn))
        .when(some(title) & year.isNotNull() & (year != 0), F.concat(normalize_title(title), F.lit("|"), year.cast("string")))
        .otherwise(F.concat(F.lit("raw:"), normalize_title(raw)))
    )


def locator(heading: Column, page: Column, printed: Column) -> Column:
    """Where a passage stands, as it is cited."""
    page, printed = F.coalesce(page, F.lit(0)), F.coalesce(printed, F.lit(0))
    return (
        F.when(F.coalesce(heading, F.lit("")) != "", heading)
        .when(page == 0, "")
        .when(printed == 0, F.concat(F.lit("PDF p. "), page.cast("string")))
        .when(printed != page, F.concat(F.lit("с. "), printed.cast("string"), F.lit(" (PDF "), page.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("с. "), page.cast("string")))
    )


def clean_tag(tag: str) -> str:
    return tag.strip().lstrip("#").rstrip("/")


def has_tag(tags: Column, tag: str) -> Column:
    """A tag or one below it, whatever the case; an empty tag is no filter."""
    want = clean_tag(tag).lower()
    if not want:
        return F.lit(True)
    return F.coalesce(F.exists(tags, lambda t: (F.lower(t) == want) | F.lower(t).startswith(want + "/")), F.lit(False))


def reference_key(kind: Column, path: Column, digest: Column) -> Column:
    """What a bibliographic record is filed under; notes have none."""
    return F.when(kind == "docs", F.concat(F.lit("manual:"), F.split_part(path, F.lit("/"), F.lit(1)))).when(kind.isin("book", "paper"), digest)


# Latin spellings of letters in keys.
SPELLINGS = dict(zip("абвгдеёзийклмнопрстуфыэ", "a b v g d e e z i y k l m n o p r s t u f y e".split(), strict=True)) | {
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya",
    "æ": "ae", "ø": "o", "ß": "ss", "œ": "oe", "ł": "l", "đ": "d", "þ": "th",
}
PLAIN = ("àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz")


def slug(c: Column) -> Column:
    """ASCII letters and digits of a name, other letters spelt in them."""
    out = F.lower(c)
    for a, b in SPELLINGS.items():
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    one = {a: b for a, b in SPELLINGS.items() if len(b) == 1}
    out = F.translate(out, "".join(one) + PLAIN[0], "".join(one.values()) + PLAIN[1])
    return F.regexp_replace(out, "[^a-z0-9]", "")


def manual_name(c: Column) -> Column:
    """A folder name: letters, digits, dot, dash and underline; runs of others one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "-"), "-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def scan_title(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)^.*/|\.pdf$", "")


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun after a number."""
    tens, units = n % 100, n % 10
    return F.when((tens >= 11) & (tens <= 14), many).when(units == 1, one).when((units >= 2) & (units <= 4), few).otherwise(many)


def short_duration(seconds: Column) -> Column:
    """The two largest units of a number of seconds."""
    s = F.floor(seconds)
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    pair = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), b.cast("string"), F.lit(y))
    return F.when(d > 0, pair(d, "d ", h, "h")).when(h > 0, pair(h, "h ", m, "m")).when(m > 0, pair(m, "m ", s % 60, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))
