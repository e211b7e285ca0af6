"""Sections and blocks of XHTML/HTML pages, as the parsers of paged and headed documents give them.

A page is cut at headings into sections with a path; paragraphs, list items and table cells are its blocks. Entities are never
fetched: the standard parser knows character references only.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "section_index int, block_index int, kind string, path string, block_text string, source_start int, source_end int"
KINDS = {"p": "PARAGRAPH", "li": "LIST_ITEM", "td": "TABLE_CELL", "th": "TABLE_CELL", "pre": "PARAGRAPH", "blockquote": "PARAGRAPH"}
SKIPPED = frozenset("script style template noscript".split())
#: Tags that can stand in a head; any other ends it.
HEAD_TAGS = SKIPPED | frozenset("html head title base link meta".split())


class Sections(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[int, str]] = []
        self.rows: list[tuple] = []
        self.section, self.block, self.at, self.skip = 0, 0, 0, 0
        self.head, self.title = False, False
        self.kind, self.texts = None, []

    def flush(self) -> None:
        text = " ".join("".join(self.texts).split())
        self.texts = []
        if not text:
            return
        kind = self.kind or "TEXT"
        if kind.startswith("h"):
            level = int(kind[1])
            self.path = [*(x for x in self.path if x[0] < level), (level, text)]
            self.section, self.block, kind = self.section + bool(self.rows), 0, "HEADING"
        self.rows.append((self.section, self.block, kind, " > ".join(t for _, t in self.path), text, self.at, self.at + len(text)))
        self.block, self.at = self.block + 1, self.at + len(text) + 1

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.title = self.head
        elif not self.skip and not self.title:
            self.head = tag == "head" or self.head and tag in HEAD_TAGS
        if tag in SKIPPED:
            self.skip += 1
        if tag in KINDS or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "article", "nav", "footer", "section", "ul", "table", "tr"):
            self.flush()
            self.kind = KINDS.get(tag, tag if tag[0] == "h" and tag[1:].isdigit() else None)

    def handle_endtag(self, tag):
        if tag in ("title", "head"):
            self.title, self.head = False, self.head and tag == "title"
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in KINDS or tag[0] == "h" and tag[1:].isdigit() or tag in ("div", "article", "nav", "footer", "section"):
            self.flush()
            self.kind = None

    def handle_data(self, data):
        if not self.skip and not self.title:
            self.head = self.head and not data.strip()
            self.texts.append(data)


def blocks(page: str | None) -> list[tuple]:
    parser = Sections()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.rows


def sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col and BLOCKS, a row per block."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in BLOCKS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(key, *b) for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for b in blocks(page)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *types], strict=True)], names=names)

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, {BLOCKS}")
