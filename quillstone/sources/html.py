"""Filing HTML to ordered elements: titles, section headers, text and tables as markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from quillstone.functions import text as X

ELEMENT = "element_type string, text string, markdown string, section string, reading_order int, row_count int, column_count int, headers array<string>"
# Tags whose text is an element.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p div li table".split())
DROPPED = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = tuple((re.compile(p, re.I), name) for p, name in X.SECTION_HEADINGS)
_NOTE, _ITEM = re.compile(X.NOTE_HEADING, re.I), re.compile(X.ITEM_HEADING, re.I)


def section_name(text: str) -> str | None:
    """The section that a heading with collapsed white space opens."""
    if m := _NOTE.match(text):
        return f"Note {m[1]} \u2014 {m[2].strip()}"
    return next((name for p, name in _HEADINGS if p.search(text)), None)


def opens_section(tag: str, text: str) -> str | None:
    """The section that a block opens: of a heading tag by its text alone, of other tags if it is short and reads as a heading."""
    heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    reads = len(text) <= X.HEADING_LENGTH and bool(_ITEM.match(text) or _NOTE.match(text) or text.casefold() in X.PLAIN_HEADINGS)
    return section_name(text) if heading or reads else None


class _Blocks(HTMLParser):
    """Collects the text of innermost blocks and the cells of outermost tables, without hidden content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, object]] = []
        self.open: list[tuple[str, bool]] = []  # tag, hidden
        self.words: list[str] = []
        self.tag: str | None = None
        self.tables = 0
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def _hidden(self) -> bool:
        return any(h for _, h in self.open)

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text and self.tag:
            self.out.append((self.tag, text))
        self.words, self.tag = [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = re.sub(r"\s", "", a.get("style") or "").lower()
        hidden = tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or tag.endswith(":hidden")
        if tag in VOID:
            if tag == "br" and not self._hidden():
                (self.cell if self.cell is not None else self.words).append(" ")
            return
        if tag == "p" or tag in BLOCKS:  # an open paragraph ends here
            while self.open and self.open[-1][0] == "p":
                self.open.pop()
        self.open.append((tag, hidden))
        if self._hidden():
            return
        if tag == "table":
            if not self.tables:
                self._flush()
                self.rows = []
            self.tables += 1
        elif self.tables:
            if self.tables == 1 and tag == "tr":
                self.rows.append([])
            elif self.tables == 1 and tag in ("td", "th"):
                self.cell = []
                if not self.rows:
                    self.rows.append([])
        elif tag in BLOCKS or tag == "title":
            self._flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        was_hidden = self._hidden()
        while self.open:
            t, _ = self.open.pop()
            if t == tag:
                break
        if was_hidden:
            return
        if self.tables:
            if self.tables == 1 and tag in ("td", "th") and self.cell is not None:
                self.rows[-1].append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif tag == "table":
                self.tables -= 1
                if not self.tables:
                    self.out.append(("table", [r for r in self.rows if any(r)]))
        elif tag in BLOCKS or tag == "title":
            self._flush()

    def handle_data(self, data):
        if self._hidden():
            return
        if self.tables:
            if self.cell is not None:
                self.cell.append(data)
        else:
            self.words.append(data)

    def close(self):
        super().close()
        self._flush()


def markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    escaped = [[c.replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(escaped[0]), line(["---"] * width), *map(line, escaped[1:])])


def elements(html: str) -> list[tuple]:
    """The rows of ELEMENT for one document; repeats in a row are kept once."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    out: list[tuple] = []
    section, last = None, None
    for tag, content in parser.out:
        if tag == "table":
            rows = content
            if not rows:
                continue
            flat = " ".join(c for r in rows for c in r if c)
            if name := opens_section("table", flat):  # a table that only lays out a heading
                section, row = name, ("section_header", flat, None, name, None, None, None)
            else:
                row = ("table", flat, markdown(rows), section, len(rows), max(map(len, rows)), rows[0])
        elif not any(c.isalnum() for c in content):
            continue
        elif tag == "title":
            row = ("title", content, None, None, None, None, None)
        elif name := opens_section(tag, content):
            section, row = name, ("section_header", content, None, name, None, None, None)
        elif tag == "h1" and not out:
            row = ("title", content, None, section, None, None, None)
        elif tag[0] == "h":
            row = ("section_header", content, None, section, None, None, None)
        else:
            row = ("text", content, None, section, None, None, None)
        if (row[0], row[1]) != last:
            out.append((*row[:4], len(out), *row[4:]))
        last = (row[0], row[1])
    return out


def parse_html(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, elements…): a row for each element of each document, in reading order; null html has none."""
    names = [f.split()[0] for f in ELEMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                rows = [(k, *e) for k, h in zip(part[key], part[html], strict=True) if h for e in elements(h)]
                yield pd.DataFrame(rows, columns=[key, *names]).astype({"row_count": "Int32", "column_count": "Int32"})

    return docs.select(key, html).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {ELEMENT}")
