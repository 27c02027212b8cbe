"""Electronic books as sections: EPUB, FB2 and MOBI, from bytes, by the formats' descriptions."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree as ET

from quire.sources.markup import VOID, Section, html_sections, mostly_links, squeeze

ENTRY_BYTES = 64 << 20
LEAST_BYTES = 150


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _find(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) == name]


def open_self_closed(text: str) -> str:
    """``<x/>`` as ``<x></x>`` for elements that have an end tag, which readers of HTML take for open ones."""
    return re.sub(r"<([A-Za-z][\w:-]*)((?:\s[^<>]*?)?)/>", lambda m: m.group() if m.group(1).lower() in VOID else f"<{m.group(1)}{m.group(2)}></{m.group(1)}>", text)


def person(name: str, file_as: str = "") -> str:
    return file_as if "," in file_as else name


def epub(data: bytes) -> tuple[list[Section], dict]:
    """Sections in reading order under the table of contents' names, and title, authors, isbn."""
    z = zipfile.ZipFile(io.BytesIO(data))

    def read(path: str) -> bytes:
        info = z.getinfo(path)
        if info.file_size > ENTRY_BYTES:
            raise ValueError(f"{path} is too large")
        return z.read(path)

    box = ET.fromstring(read("META-INF/container.xml"))
    root = _find(box, "rootfile")[0].attrib["full-path"]
    base, opf = posixpath.dirname(root), ET.fromstring(read(root))
    at = lambda href: posixpath.normpath(posixpath.join(base, href.split("#")[0]))
    items = {e.attrib.get("id"): e.attrib for e in _find(opf, "item")}
    names: dict[str, str] = {}
    ncx = next((i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    nav = next((i for i in items.values() if "nav" in i.get("properties", "").split()), None)
    if ncx is not None:
        toc = ET.fromstring(read(at(ncx["href"])))

        def points(e: ET.Element, trail: list[str]) -> None:
            for p in [x for x in e if _name(x) == "navpoint"]:
                label = squeeze("".join(next(iter(_find(p, "navlabel")), ET.Element("x")).itertext()))
                src = next((x.attrib.get("src", "") for x in p if _name(x) == "content"), "")
                here = [*trail, label] if label else trail
                names.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(at(ncx["href"])), src.split("#")[0])), " > ".join(here))
                points(p, here)

        for m in _find(toc, "navmap"):
            points(m, [])
    elif nav is not None:
        for a in _find(ET.fromstring(re.sub(rb"&(?!amp;|lt;|gt;|quot;|apos;|#)\w+;", b" ", read(at(nav["href"])))), "a"):
            names.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(at(nav["href"])), a.attrib.get("href", "").split("#")[0])), squeeze("".join(a.itertext())))
    out: list[Section] = []
    for ref in _find(opf, "itemref"):
        item = items.get(ref.attrib.get("idref"))
        if not item or "html" not in item.get("media-type", "") or item is nav:
            continue
        text = open_self_closed(read(at(item["href"])).decode("utf-8", "replace"))
        if mostly_links(text):
            continue
        chapter = names.get(at(item["href"]), "")
        for s in html_sections(text, LEAST_BYTES):
            inner = s.heading if not chapter or s.heading == chapter.rpartition(" > ")[2] else f"{chapter} > {s.heading}" if s.heading else chapter
            out.append(Section(chapter if s.heading and chapter.endswith(s.heading) else inner, s.body, s.anchor))
    meta = {"title": next((squeeze("".join(e.itertext())) for e in _find(opf, "title")), ""), "authors": [], "isbn": ""}
    for e in _find(opf, "creator"):
        role = next((v for k, v in e.attrib.items() if k.endswith("role")), "aut")
        file_as = next((v for k, v in e.attrib.items() if k.endswith("file-as")), "")
        if role == "aut":
            meta["authors"].append(person(squeeze("".join(e.itertext())), file_as))
    for e in _find(opf, "identifier"):
        digits = re.sub(r"[^\dXx]", "", "".join(e.itertext()))
        if len(digits) in (10, 13) and ("isbn" in ET.tostring(e, "unicode").lower() or digits.startswith(("978", "979"))):
            meta["isbn"] = digits.upper()
            break
    return out, meta


def fb2(data: bytes) -> tuple[list[Section], dict]:
    """Sections of the unnamed bodies under nested titles; notes, pictures and the description are no text."""
    text = _decoded(data)
    root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;", text)))
    out: list[Section] = []

    def words(e: ET.Element) -> str:
        got = e.text or ""
        for k in e:
            if not (_name(k) == "a" and k.attrib.get("type") == "note"):
                got += words(k)
            got += k.tail or ""
        return got

    def section(e: ET.Element, trail: list[str]) -> None:
        paragraphs: list[str] = []
        title = next((squeeze(" ".join(words(p) for p in _find(t, "p"))) for t in e if _name(t) == "title"), "")
        here = [*trail, title] if title else trail

        def flush() -> None:
            body = "\n\n".join(paragraphs)
            if len(body.encode()) >= LEAST_BYTES:
                out.append(Section(" > ".join(here), body))
            paragraphs.clear()

        for k in e:
            if _name(k) == "section":
                flush()
                section(k, here)
            elif _name(k) not in ("title", "image"):
                parts = [squeeze(words(p)) for p in ([k] if _name(k) in ("p", "subtitle") else [x for x in k.iter() if _name(x) in ("p", "v", "subtitle", "text-author")])]
                paragraphs += [p for p in parts if p]
        flush()

    for body in [x for x in root if _name(x) == "body" and not x.attrib.get("name")]:
        section(body, [])
    info = next(iter(_find(root, "title-info")), ET.Element("x"))
    authors = []
    for a in [x for x in info if _name(x) == "author"]:
        part = {_name(x): squeeze(x.text or "") for x in a}
        given = " ".join(x for x in (part.get("first-name"), part.get("middle-name")) if x)
        authors.append(f"{part.get('last-name', '')}, {given}" if part.get("last-name") and given else part.get("last-name") or part.get("nickname") or given)
    isbn = next((re.sub(r"[^\dXx]", "", e.text or "").upper() for e in _find(root, "isbn")), "")
    return out, {"title": next((squeeze(e.text or "") for e in _find(info, "book-title")), ""), "authors": [a for a in authors if a], "isbn": isbn}


def _decoded(data: bytes) -> str:
    m = re.match(rb"\s*(?:\xef\xbb\xbf)?<\?xml[^>]*encoding=[\"']([\w-]+)", data)
    try:
        return data.decode(m.group(1).decode() if m else "utf-8-sig")
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "replace")


def unpack_palmdoc(data: bytes) -> bytes:
    """The PalmDOC compression: literals, runs, pairs of distance and length, and spaces with a character."""
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            distance, length = pair >> 3, (pair & 7) + 3
            for _ in range(length if 0 < distance <= len(out) else 0):
                out.append(out[-distance])
    return bytes(out)


def _trailing(record: bytes, flags: int) -> bytes:
    """A record without the entries after its text."""
    for bit in range(15, 0, -1):
        if flags >> bit & 1 and record:
            size = shift = 0
            for k in range(1, min(4, len(record)) + 1):
                b = record[-k]
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            record = record[: len(record) - size]
    if flags & 1 and record:
        record = record[: len(record) - (record[-1] & 3) - 1]
    return record


def mobi(data: bytes) -> tuple[list[Section], dict]:
    """Sections and metadata of a MOBI book; later formats, Huffman compression and protected books are refused."""
    if data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise ValueError("no MOBI book")
    n = struct.unpack_from(">H", data, 76)[0]
    starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    first = data[starts[0] : starts[1]]
    compression, _, _, records = struct.unpack_from(">HHIH", first, 0)
    if compression not in (1, 2):
        raise ValueError("unknown compression")
    if struct.unpack_from(">H", first, 12)[0]:
        raise ValueError("the book is protected")
    has = first[16:20] == b"MOBI"
    size = struct.unpack_from(">I", first, 20)[0] if has else 0
    if has and struct.unpack_from(">I", first, 36)[0] >= 8:
        raise ValueError("a later format")
    charset = "utf-8" if has and struct.unpack_from(">I", first, 28)[0] == 65001 else "cp1252"
    flags = struct.unpack_from(">H", first, 242)[0] if has and size >= 228 else 0
    raw = b"".join((unpack_palmdoc if compression == 2 else bytes)(_trailing(data[starts[i] : starts[i + 1]], flags)) for i in range(1, min(records, n - 1) + 1))
    meta = {"title": "", "authors": [], "isbn": ""}
    if has and len(first) >= 132:
        at, length = struct.unpack_from(">II", first, 84)
        meta["title"] = first[at : at + length].decode(charset, "replace")
        if struct.unpack_from(">I", first, 128)[0] & 0x40 and first[16 + size : 20 + size] == b"EXTH":
            pos, count = 28 + size, struct.unpack_from(">I", first, 24 + size)[0]
            for _ in range(count):
                kind, length = struct.unpack_from(">II", first, pos)
                value = first[pos + 8 : pos + length].decode(charset, "replace")
                if kind == 100:
                    meta["authors"].append(value)
                elif kind == 104:
                    meta["isbn"] = re.sub(r"[^\dXx]", "", value)
                elif kind == 503:
                    meta["title"] = value
                pos += max(8, length)
    # the guide's reference to a table of contents, and the places it leads to, are offsets of bytes
    toc = re.search(rb"<reference[^>]*type=\"?toc\"?[^>]*filepos=\"?(\d+)", raw)
    names: dict[int, str] = {}
    if toc:
        for m in re.finditer(rb"<a[^>]*filepos=\"?(\d+)\"?[^>]*>(.*?)</a>", raw[int(toc.group(1)) :], re.S):
            names.setdefault(int(m.group(1)), squeeze(re.sub(r"<[^>]+>", " ", m.group(2).decode(charset, "replace"))))
    cuts = sorted(x for x in names if 0 < x < len(raw)) or [0]
    out = []
    for a, b in zip(cuts, [*cuts[1:], int(toc.group(1)) if toc and int(toc.group(1)) > cuts[-1] else len(raw)], strict=True):
        for s in html_sections(raw[a:b].decode(charset, "replace"), LEAST_BYTES):
            out.append(Section(names.get(a, "") or s.heading, s.body))
    return out, meta
