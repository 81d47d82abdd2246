"""What a page's markup says: headings with their path, tables with the cells of their own, blocks of text, outside boilerplate."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements and containers that hold no content, elements without an end, elements that hold a block of text.
SKIPPED = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form"}
MARKERS = ["cookie", "consent", "banner", "cookiebar", "gdpr", "newsletter", "subscribe", "advert", "sidebar"]
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "param", "track", "wbr", "keygen"}
BLOCKS = {"p", "li", "caption", "blockquote", "dd", "dt"}

HEADINGS = {f"h{i}" for i in range(1, 7)}
#: What a start tag ends if it is open, up to the element that bounds the search (the table for cells and rows).
CLOSES = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}}
BOUNDS = {"td": "table", "th": "table", "tr": "table", "tbody": "table", "li": "ul", "dt": "dl", "dd": "dl", "p": "td"}
CLOSES |= {"thead": CLOSES["tbody"], "tfoot": CLOSES["tbody"]} | {h: {"p"} for h in HEADINGS} | {"table": {"p"}}
BOUNDS |= {"thead": "table", "tfoot": "table"}
WIDEST = 40  # columns that one cell may span
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">]){0,2000}+)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
MATTERS = re.compile("class|id|span", re.I)
LEAST = 40  # characters of a block of text


def _attributes(text: str) -> dict[str, str]:
    """Those of a tag that matter here: class, id and spans."""
    if not text or not MATTERS.search(text):
        return {}
    return {m.group(1).lower(): html.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in ATTRIBUTE.finditer(text)}


def _folded(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


class _Table:
    def __init__(self, number: int, parent: int | None, path: list[str]):
        self.number, self.parent, self.path = number, parent, path
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.span = (1, 1)
        self.down: dict[int, tuple[int, str]] = {}  # column: rows that a cell above still covers, its text

    def _carried(self) -> None:
        while self.row is not None and len(self.row) in self.down:
            left, text = self.down.pop(at := len(self.row))
            if left > 1:
                self.down[at] = left - 1, text
            self.row.append(text)

    def end_cell(self) -> None:
        if self.cell is not None:
            text, (wide, high) = _folded(self.cell), self.span
            for _ in range(wide):
                self._carried()
                if high > 1:
                    self.down[len(self.row)] = high - 1, text
                self.row.append(text)
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self._carried()
            self.rows.append(self.row)
            self.row = None

    def start_cell(self, attributes: dict[str, str]) -> None:
        if self.row is None:
            self.row = []
        self._carried()
        count = lambda name: min(int(v), WIDEST) if (v := attributes.get(name, "1").strip()).isdecimal() and int(v) else 1
        self.cell, self.span = [], (count("colspan"), count("rowspan"))


def read(page: str) -> dict:
    """title; headings: level, title, path; tables: table_no, parent, path, rows; blocks: path and text.

    One pass over the tags with a stack of open elements. A table's cell keeps its own text when a table stands in it; that
    one is a table of its own, with the outer one as parent. Cells are repeated over the columns and rows they span. Left out is
    what SKIPPED elements and elements with a marker in class or id hold. Missing end tags of cells, rows, items and paragraphs
    are supplied; an end tag without a start is ignored; what is open at the end is closed.
    """
    headings: list[dict] = []
    tables: list[_Table] = []
    blocks: list[dict] = []
    stack: list[tuple[str, bool]] = []
    standing: Counter[str] = Counter()  # how many elements of a name are open
    open_tables: list[_Table] = []
    open_headings: list[tuple[int, str]] = []
    title: list[str] | None = None
    block: tuple[str, list[str]] | None = None
    skipping = 0
    titled: str | None = None

    def end_block() -> None:
        nonlocal block
        if block is None:
            return
        tag, text = block[0], _folded(block[1])
        block = None
        if tag in HEADINGS:
            if text:
                level = int(tag[1])
                while open_headings and open_headings[-1][0] >= level:
                    open_headings.pop()
                open_headings.append((level, text))
                headings.append({"level": level, "title": text, "path": [t for _, t in open_headings]})
        elif len(text) >= LEAST:
            blocks.append({"path": [t for _, t in open_headings], "text": text})

    def close(tag: str) -> None:
        nonlocal titled, title
        if tag == "title" and title is not None:
            titled, title = titled or _folded(title) or None, None
        elif block is not None and tag == block[0]:
            end_block()
        elif open_tables and tag in ("td", "th"):
            open_tables[-1].end_cell()
        elif open_tables and tag == "tr":
            open_tables[-1].end_row()
        elif open_tables and tag == "table":
            open_tables.pop().end_row()

    def pop(upto: int) -> None:
        """Closes the open elements from `upto` on, the inner first."""
        nonlocal skipping
        while len(stack) > upto:
            tag, skipped = stack.pop()
            standing[tag] -= 1
            if skipped:
                skipping -= 1
            elif not skipping:
                close(tag)

    at = 0
    for m in MARK.finditer(page):
        if m.start() > at and not skipping:
            data = page[at : m.start()]
            for sink in (title, open_tables[-1].cell if open_tables else None, block and block[1]):
                if sink is not None:
                    sink.append(data)
                    break
        at = m.end()
        tag = (m.group("tag") or "").lower()
        if not tag:
            continue
        if m.group("end"):
            for i in range(len(stack) - 1, -1, -1) if standing[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] == "table" and tag not in SKIPPED and tag not in ("body", "html", "div", "section", "article", "main"):
                    break  # a stray end tag in a cell closes nothing outside the table
            continue
        if tag in VOID:
            if not skipping:
                for sink in (title, open_tables[-1].cell if open_tables else None, block and block[1]):
                    if sink is not None:
                        sink.append(" ")
                        break
            continue
        attributes = _attributes(m.group("attrs"))
        if tag in CLOSES and any(standing[x] for x in CLOSES[tag]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    pop(i)
                elif stack[i][0] == BOUNDS.get(tag, "table"):
                    break
        marked = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower() if attributes else ""
        skipped = tag in SKIPPED or bool(marked) and any(x in marked for x in MARKERS)
        stack.append((tag, skipped))
        standing[tag] += 1
        skipping += skipped
        if m.group("attrs").endswith("/") and tag not in HEADINGS | BLOCKS and not skipped:
            pop(len(stack) - 1)  # <x/> holds nothing
            continue
        if skipping:
            continue
        if tag == "title":
            title = []
        elif tag in HEADINGS or tag in BLOCKS:
            if open_tables and open_tables[-1].cell is not None:
                open_tables[-1].cell.append(" ")  # within a cell its text is the cell's
            else:
                end_block()
                block = (tag, [])
        elif tag == "table":
            table = _Table(len(tables), open_tables[-1].number if open_tables else None, [t for _, t in open_headings])
            end_block()
            tables.append(table)
            open_tables.append(table)
        elif open_tables and tag == "tr":
            open_tables[-1].end_row()
            open_tables[-1].row = []
        elif open_tables and tag in ("td", "th"):
            open_tables[-1].start_cell(attributes)
        elif open_tables and open_tables[-1].cell is not None:
            open_tables[-1].cell.append(" " if tag in ("div", "ul", "ol", "section") else "")
    if not skipping and at < len(page):
        for sink in (open_tables[-1].cell if open_tables else None, block and block[1]):
            if sink is not None:
                sink.append(page[at:])
                break
    pop(0)
    end_block()
    rows = [{"table_no": t.number, "parent": t.parent, "path": t.path, "rows": kept} for t in tables if (kept := [r for r in t.rows if any(r)])]
    return {"title": titled, "headings": headings, "tables": rows, "blocks": blocks}


_TEXTS = pa.list_(pa.string())
_SHAPE = {
    "title": pa.string(),
    "headings": pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("path", _TEXTS)])),
    "tables": pa.list_(pa.struct([("table_no", pa.int32()), ("parent", pa.int32()), ("path", _TEXTS), ("rows", pa.list_(_TEXTS))])),
    "blocks": pa.list_(pa.struct([("path", _TEXTS), ("text", pa.string())])),
}
_DDL = "title string, headings array<struct<level:int,title:string,path:array<string>>>, tables array<struct<table_no:int,parent:int,path:array<string>,rows:array<array<string>>>>, blocks array<struct<path:array<string>,text:string>>"


def structure(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """A row for each page: id, and what read() gives. Null and empty pages have empty lists; no page fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # few pages' trees at once
                part = batch.slice(i, 64)
                found = [read(t.as_py() or "") for t in part.column("__html")]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *(pa.array([x[c] for x in found], k) for c, k in _SHAPE.items())], names=["__id", *_SHAPE])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__html")).mapInArrow(run, f"__id {kind}, {_DDL}").withColumnRenamed("__id", id_col)


def headings(tree: DataFrame, id_col: str) -> DataFrame:
    """Level, title and path of every heading outside boilerplate: the path has the open headings above it, outermost first, and itself."""
    return tree.select(id_col, F.posexplode("headings").alias("n", "h")).select(id_col, "n", "h.level", "h.title", F.array_join("h.path", " > ").alias("path"))


def table_rows(tree: DataFrame, id_col: str) -> DataFrame:
    """A row for each table row that has text: table_no, parent (the table around it), path of headings, row_no, cells."""
    tables = tree.select(id_col, F.inline("tables"))
    return tables.select(id_col, "table_no", "parent", F.array_join("path", " > ").alias("path"), F.posexplode("rows").alias("row_no", "cells"))
