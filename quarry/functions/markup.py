"""Acts marked up by element ids: recitals, articles with their divisions, annexes. One pass over the tags of a page, run as an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.columns import batch_of, slices

# The ids and classes that mark an act's parts.
RECITAL, ARTICLE, ANNEX = re.compile(r"rct_\d+$"), re.compile(r"art_[0-9]+[a-z]*$"), re.compile(r"anx_[^.]+$")
DIVISION, PARAGRAPH = re.compile(r"(?:^|\.)(?:cpt|tis|prt|sct|sbs)_[^.]+$"), re.compile(r"\d{3}\.\d{3}$")
NUMBER_CLASS, TITLE_CLASS, MARKER_CLASS = "oj-ti-art", "oj-sti-art", "eli-container"
VOID = {"br", "hr", "img", "input", "link", "meta", "col", "area", "base", "source", "wbr"}
#: A tag of these ends an open one of the same kind.
ENDS = {"p": {"p"}, "td": {"td", "p"}, "tr": {"tr", "td", "p"}, "div": {"p"}, "table": {"p"}}
LONGEST_TITLE = 120


@dataclass
class _Open:
    """An element that is open, and what its closed children left: all text, the lines, how many paragraphs."""

    tag: str
    id: str = ""
    classes: frozenset[str] = frozenset()
    order: int = 0
    text: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    paragraphs: int = 0
    cells: list[tuple[str, int]] = field(default_factory=list)
    named: dict[str, str] = field(default_factory=dict)  # what titles it: by kind
    units: list[str] = field(default_factory=list)


def _line(text: str) -> str:
    return re.sub("[ \t\xa0]+", " ", text).strip()


def _joined(*parts: str, by: str = " ") -> str:
    return by.join(x for x in parts if x)


class _Pieces(HTMLParser):
    """Keeps the open elements only. What an element means for those around it is settled when it closes."""

    def __init__(self, wanted: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Open("root")]
        self.seen = 0
        self.found: list[tuple[int, str, str, str]] = []
        self.wanted, self.kept = wanted, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        while self.open[-1].tag in ENDS.get(tag, ()):
            self._close()
        named = dict(attrs)
        self.seen += 1
        self.open.append(_Open(tag, named.get("id") or "", frozenset((named.get("class") or "").split()), self.seen))

    def handle_endtag(self, tag: str) -> None:
        if any(x.tag == tag for x in self.open[1:]):
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].text.append(data)

    def finish(self) -> None:
        self.close()
        while len(self.open) > 1:
            self._close()

    def _close(self) -> None:
        done = self.open.pop()
        above, text = self.open[-1], "".join(done.text)
        line = _line(text)
        if done.tag == "p":
            done.lines = [line] if line else []
            above.named.setdefault("heading", line)
            self._title_article(done.classes, line)
        elif done.tag == "tr" and 0 < len(done.cells) <= 3 and all(n <= 1 for _, n in done.cells):
            row = _joined(*(x for x, _ in done.cells))
            done.lines = [row] if row else []
        elif done.tag == "td":
            above.cells.append((line, done.paragraphs))
        if done.id and done.id == f"{above.id}.tit_1":
            above.named["title"] = line
        if done.id and done.id == self.wanted:
            self.kept = done.lines
        if done.tag == "div":
            self._settle(done)
        above.text.append(text)
        above.lines += done.lines
        above.paragraphs += done.paragraphs + (done.tag == "p")

    def _articles(self):
        return (x for x in reversed(self.open) if x.tag == "div" and ARTICLE.match(x.id))

    def _title_article(self, classes: frozenset[str], line: str) -> None:
        for kind in classes & {NUMBER_CLASS, TITLE_CLASS}:
            for article in self._articles():
                article.named.setdefault(kind, line)

    def _settle(self, div: _Open) -> None:
        if PARAGRAPH.match(div.id):
            for article in self._articles():
                article.units.append("\n".join(div.lines))
        if RECITAL.match(div.id):
            self._emit(div, "preamble", "Recitals", div.lines)
        elif ARTICLE.match(div.id):
            number, title = (div.named.get(k, "") for k in (NUMBER_CLASS, TITLE_CLASS))
            skipped = next((i for i, x in enumerate(div.lines) if x not in (number, title)), len(div.lines))
            units = [u for u in div.units if u] if div.units else div.lines[skipped:]
            self._emit(div, "article", _joined(*self._divisions(), _joined(number, title), by=" | "), units)
        elif ANNEX.match(div.id):
            head, *rest = div.lines or ["Annex"]
            titled = bool(rest) and len(rest[0]) <= LONGEST_TITLE
            self._emit(div, "annex", _joined(head, rest[0] if titled else ""), rest[titled:])

    def _divisions(self):
        """Titles of the divisions around, the widest first."""
        for x in self.open:
            if x.tag == "div" and DIVISION.search(x.id):
                heading, title = (x.named.get(k, "") for k in ("heading", "title"))
                yield heading if heading == title else _joined(heading, title)

    def _emit(self, div: _Open, section: str, label: str, lines: list[str]) -> None:
        if body := "\n".join(lines):
            self.found.append((div.order, section, label, body))


def _read(html: str, wanted: str = "") -> _Pieces:
    reader = _Pieces(wanted)
    reader.feed(re.sub(r"^\s*<\?xml[^>]*\?>", "", html))
    reader.finish()
    return reader


def tagged_pieces(html: str) -> list[tuple[str, str, str]]:
    """(section, label, body) of each recital, article and annex, in order."""
    return [p[1:] for p in sorted(_read(html).found)]


def element_text(html: Column, wanted: str) -> Column:
    """The lines of the element of this id, as one text; null where a page has none."""

    def lines(page: str | None) -> str | None:
        kept = _read(page, wanted).kept if page else None
        return None if kept is None else "\n".join(kept)

    @F.arrow_udf("string")
    def read(pages: pa.Array) -> pa.Array:
        few = slices(iter([pa.RecordBatch.from_arrays([pages], ["page"])]))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([lines(p) for p in x.column(0).to_pylist()], pa.string()) for x in few)])

    return read(html)


def is_tagged(html: Column) -> Column:
    return F.coalesce(html.rlike(f"""<div\\b[^>]*class=["']{MARKER_CLASS}["']"""), F.lit(False))


def pieces(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, place, section, label, body) of marked-up pages (doc_id, html), with columns to keep. The pieces of a page follow one another."""

    plain = pages.select("doc_id", *keep, "html")
    kind = {f.name: f.dataType.simpleString() for f in plain.schema}
    columns = f"doc_id {kind['doc_id']}, place int, section string, label string, body string" + "".join(f", `{c}` {kind[c]}" for c in keep)
    schema = to_arrow_schema(T.StructType.fromDDL(columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in slices(batches):
            rows = zip(*(c.to_pylist() for c in few.columns), strict=True)
            yield batch_of([(own, i, *p, *kept) for own, *kept, html in rows for i, p in enumerate(tagged_pieces(html))], schema)

    return plain.where(is_tagged(F.col("html"))).mapInArrow(read, columns)
