"""What a reader sees of a hit: marked words, blocks of code, an address, a form's changes."""

from __future__ import annotations

import re
from urllib.parse import quote


def segments(text: str) -> list[tuple[str, bool]]:
    """A snippet in parts, with whether each was marked by << >>."""
    out, at = [], 0
    for m in re.finditer(r"<<(.*?)>>", text, re.S):
        if m.start() > at:
            out.append((text[at : m.start()], False))
        out.append((m.group(1), True))
        at = m.end()
    return out + ([(text[at:], False)] if at < len(text) else [])


def blocks(body: str) -> list[tuple[str, bool]]:
    """Prose and fenced code of a body in order, with whether each is code; an open fence runs to the end."""
    out: list[tuple[str, bool]] = []
    lines: list[str] = []
    code = False

    def flush() -> None:
        text = "\n".join(lines) if code else "\n".join(lines).strip()
        if text.strip():
            out.append((text, code))
        lines.clear()

    for line in body.split("\n"):
        if line.lstrip().startswith("```"):
            flush()
            code = not code
        else:
            lines.append(line)
    flush()
    return out


def source_address(kind: str, path: str, page: int | None = None, anchor: str | None = None) -> str:
    """Where a source opens: at a page or an anchor."""
    url = f"/files/{kind}/{quote(path)}"
    if kind in ("book", "paper") and path.lower().endswith(".pdf") and page:
        return f"{url}#page={page}"
    return f"{url}#{quote(anchor)}" if kind == "docs" and anchor else url


def changes(current: dict, found: dict) -> dict[str, tuple]:
    """Fields in which a found record says something else."""
    return {k: (current.get(k), v) for k, v in found.items() if v not in (None, "", []) and current.get(k) != v}


def cited_page(locator: str) -> str | None:
    """The printed page of a locator, which is what a citation names."""
    m = re.match(r"^с\. (\d+)", locator)
    return m.group(1) if m else None


def title_language(title: str) -> str:
    """The language most letters of a title are written in."""
    cyr = sum("Ѐ" <= c <= "ӿ" for c in title)
    return "ru-RU" if cyr > sum(c.isascii() and c.isalpha() for c in title) else "en-US"


def latex_citation(citekey: str, locator: str = "") -> str:
    page = cited_page(locator)
    return f"\\cite[{page}]{{{citekey}}}" if page else f"\\cite{{{citekey}}}"


def pandoc_citation(citekey: str, locator: str = "") -> str:
    page = cited_page(locator)
    return f"[@{citekey}, p. {page}]" if page else f"[@{citekey}]"
