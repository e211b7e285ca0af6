"""Sections of parsed documents with their structure: nested ranges over a section's text.

Paged documents give a section per page (or one in all) with pages, paragraphs and lines; flowing ones give one section with
headings, paragraphs, and tables of rows of cells. Both come as XHTML text. A section's text is its leaves joined by line ends;
containers (PAGE, TABLE, TABLE_ROW, TABLE_CELL) and lines are ranges over leaves, so all offsets are code points into that text.

Text is strict XML without a document type, hence without entities of its own, or, with strict=False, any HTML: missing end tags
are supplied and elements that only wrap others are stepped into. A text that can't be read gives one row with an error and no
section; a null or empty one counts as that, too. Blank leaves are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<kind:string,start:int,end:int,path:array<string>,confidence:string,metadata:map<string,string>>"
SECTIONS = f"section int, text string, page int, page_count int, format string, language string, blocks array<{BLOCK}>, error string"

#: White space that is trimmed (a no-break space becomes a space before), list markers, and the length of a heading in a path.
SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000)))
LIST_MARKER = re.compile("\\s*(\\d+[.)]|[-*•])\\s+", re.ASCII)
PATH_TEXT = 80

HEADINGS = tuple(f"h{k}" for k in range(1, 7))
#: Elements of HTML: those without an end tag, those whose text is none, those that wrap blocks, and what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("head script style template noscript title".split())
WRAPPERS = frozenset("div article section main header footer aside nav center form".split())
ENDED_BY = {"p": frozenset((*HEADINGS, *WRAPPERS, "p", "table", "ul", "ol", "pre", "blockquote")), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}


class Node:
    """An element: its attributes and its parts, texts and elements, in order."""

    __slots__ = ("attributes", "parts", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.parts = tag.lower().rpartition(":")[2], attributes, []

    def elements(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def walk(self) -> Iterator[Node | str]:
        """All texts and elements inside, in document order, without recursion."""
        todo = self.parts[::-1]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo += x.parts[::-1]

    def within(self) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node))

    def text(self) -> str:
        return clean("".join(x for x in self.walk() if isinstance(x, str)))


def clean(text: str) -> str:
    return text.replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n").strip(SPACE)


def strict_tree(text: str) -> Node:
    root = Node("", {})
    open_nodes, parser = [root], expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def start(tag, attributes):
        open_nodes.append(Node(tag, attributes))
        open_nodes[-2].parts.append(open_nodes[-1])

    def refuse(*_):
        raise ValueError("DOCTYPE")

    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: open_nodes.pop()
    parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = lambda data: open_nodes[-1].parts.append(data), refuse
    try:
        parser.Parse(text.encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        raise ValueError("NOT_WELL_FORMED") from e
    return root


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
            if tag == "tr" and self.open[-1].tag == "tr":  # a cell without an end tag, in a row without one
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if not any(x.tag in SILENT for x in self.open[-2:]):
            self.open[-1].parts.append(data)


def html_tree(text: str) -> Node:
    parser = _Html()
    parser.feed(text)
    parser.close()
    return parser.root


class Written:
    """A section as it is written: its text so far and its blocks (kind, start, end, path, confidence, metadata)."""

    def __init__(self):
        self.texts: list[str] = []
        self.leaves: list[tuple[int, int]] = []
        self.blocks: list[tuple] = []
        self.tables, self.size = 0, 0

    def leaf(self, text: str, kind: str, path: tuple[str, ...], sure: bool, **metadata: str) -> None:
        if text:
            start = self.size + bool(self.texts)
            self.texts.append(text)
            self.size = start + len(text)
            self.leaves.append((start, self.size))
            self.blocks.append((kind, start, self.size, path, "AUTHORITATIVE" if sure else "HINT", metadata))

    def unknown(self, node: Node, path: tuple[str, ...]) -> None:
        self.leaf(node.text(), "TEXT", path, False, sourceElement=node.tag)

    def paragraph(self, node: Node, path: tuple[str, ...]) -> None:
        text, more = node.text(), {}
        if node.attributes.get("class", "").strip(SPACE):
            more |= {"styleClass": node.attributes["class"], "styleConfidence": "HINT"}
        if marker := LIST_MARKER.match(text):
            more |= {"listMarker": marker[1], "listConfidence": "HINT"}
        self.leaf(text, "PARAGRAPH", (*path, "paragraph"), True, **more)

    def around(self, since: int, kind: str, path: tuple[str, ...], **metadata: str) -> None:
        """A container of all leaves from the since-th on; none if there are none."""
        if len(self.leaves) > since:
            self.blocks.append((kind, self.leaves[since][0], self.leaves[-1][1], path, "AUTHORITATIVE", metadata))

    def lines(self, since: int, path: tuple[str, ...]) -> None:
        """The lines of the leaf that is the since-th, if there is one, numbered without empty ones."""
        if len(self.leaves) > since:
            start, number = self.leaves[since][0], 0
            for line in self.texts[-1].split("\n"):
                if line:
                    number += 1
                    self.blocks.append(("LINE", start, start + len(line), (*path, f"line[{number}]"), "HINT", {"boundarySource": "layout"}))
                start += len(line) + 1

    def section(self, index: int, kind: str, page: int | None = None, pages: int | None = None) -> tuple:
        ordered = sorted(self.blocks, key=lambda b: (b[1], -b[2]))  # stable: of equal ranges the inner one is first
        return index, "\n".join(self.texts), page, pages, kind, None, ordered, None


def _table(out: Written, table: Node, path: tuple[str, ...]) -> None:
    out.tables += 1
    path, first, cells = (*path, f"table[{out.tables}]"), len(out.leaves), 0
    for r, row in enumerate((x for x in table.within() if x.tag == "tr"), 1):
        row_path, row_first = (*path, f"row[{r}]"), len(out.leaves)
        for c, cell in enumerate((x for x in row.elements() if x.tag in ("td", "th")), 1):
            cell_path, cell_first = (*row_path, f"cell[{c}]"), len(out.leaves)
            for child in cell.elements():
                if child.tag == "p":
                    out.paragraph(child, cell_path)
                else:
                    out.unknown(child, (*cell_path, f"unrecognized[{child.tag}]"))
            if not cell.elements():
                out.unknown(cell, cell_path)
            out.around(cell_first, "TABLE_CELL", cell_path)
            cells += 1
        out.around(row_first, "TABLE_ROW", row_path)
    if cells:
        out.around(first, "TABLE", path)
    else:
        out.unknown(table, (*path, "unrecognized[table]"))


def _unwrapped(node: Node) -> Iterator[Node]:
    """The elements of a node; those that only wrap blocks give theirs instead. Texts beside blocks stay, as elements of their own."""
    blocks = (*HEADINGS, *WRAPPERS, "p", "table")
    todo = [node]
    while todo:
        x = todo.pop()
        if x is node or x.tag in WRAPPERS and any(e.tag in blocks for e in x.elements()):
            parts = []
            for part in x.parts:
                if isinstance(part, str):
                    part, text = Node(x.tag, {}), part
                    part.parts.append(text)
                parts.append(part)
            todo += parts[::-1]
        elif x.tag not in SILENT:
            yield x


def flowing(root: Node, strict: bool = True) -> list[tuple]:
    """The one section of a flowing document: the elements of its body under their headings. A heading closes those of its level
    and below; levels left out are placeholders in the path."""
    out, headings = Written(), []
    body = next((x for x in root.within() if x.tag == "body"), None if strict else root)
    for node in () if body is None else body.elements() if strict else _unwrapped(body):
        if node.tag in HEADINGS:
            level, text = int(node.tag[1]), node.text()
            headings = headings[: level - 1] + [f"heading[{k}]" for k in range(len(headings) + 1, level)]
            headings.append(f"heading[{level}]:{text.replace(chr(10), ' ').strip(SPACE)[:PATH_TEXT]}")
            out.leaf(text, "HEADING", ("body", *headings), True, level=str(level))
            continue
        path = ("body", *headings)
        if node.tag == "p":
            out.paragraph(node, path)
        elif node.tag == "table":
            _table(out, node, path)
        else:
            out.unknown(node, (*path, f"unrecognized[{node.tag}]"))
    return [out.section(0, "DOCX")]


def paged(root: Node, split_pages: bool = True, max_pages: int | None = None) -> list[tuple]:
    """The sections of a paged document, one for each of its first max_pages pages (all, if that is null or not positive), or one over those."""
    pages = [x for x in root.within() if "page" in x.attributes.get("class", "").split()]
    taken = pages[:max_pages] if max_pages is not None and max_pages > 0 else pages
    found, out = [], Written()
    for number, page in enumerate(taken, 1):
        out = Written() if split_pages else out
        path, first = (f"page[{number}]",), len(out.leaves)
        for child in page.elements():
            at = len(out.leaves)
            if child.tag == "p":
                out.leaf(child.text(), "PARAGRAPH", (*path, "paragraph"), False, boundarySource="layout")
                out.lines(at, path)
            else:
                out.unknown(child, (*path, f"unrecognized[{child.tag}]"))
        if not page.elements():
            out.leaf(page.text(), "TEXT", (*path, "text"), False)
        out.around(first, "PAGE", path, pageNumber=str(number))
        if split_pages:
            found.append(out.section(number - 1, "PDF", number, len(pages)))
    return found if split_pages else [out.section(0, "PDF")]


def parsed(text: str | None, kind: str, strict: bool = True, split_pages: bool = True, max_pages: int | None = None) -> list[tuple]:
    """The sections of a document, as rows of SECTIONS."""
    try:
        root = (strict_tree if strict else html_tree)(text or "")
    except ValueError as e:
        return [(None, None, None, None, kind, None, None, str(e))]
    return paged(root, split_pages, max_pages) if kind == "PDF" else flowing(root, strict)


def sections(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "xhtml", strict: bool = True, split_pages: bool = True, max_pages: int | None = None, step: int = 64) -> DataFrame:
    """id_col and SECTIONS of documents of a kind, PDF (paged) or DOCX (flowing); what chunking.section_chunks takes, where error is
    null. A document is read in one task, rows leave it in batches of `step` documents."""
    if kind not in ("PDF", "DOCX"):
        raise ValueError(f"unknown kind {kind}")
    key = docs.schema[id_col].dataType.simpleString()
    block = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("path", pa.list_(pa.string())), ("confidence", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(block), pa.string()]
    names = [id_col, *(x.split()[0] for x in SECTIONS.replace(BLOCK, "").split(", "))]
    fields = ("kind", "start", "end", "path", "confidence", "metadata")

    def rows(key, text) -> Iterator[tuple]:
        for section in parsed(text, kind, strict, split_pages, max_pages):
            blocks = section[6] and [dict(zip(fields, (*b[:5], list(b[5].items())), strict=True)) for b in section[6]]
            yield key, *section[:6], [] if blocks is None and section[7] is None else blocks, section[7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                out = [row for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in rows(own, text)]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [part.schema.field(0).type, *types], strict=True)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, {SECTIONS}")


def blocks(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per block: id_col, section, page, page_count, kind, path (joined by slashes), confidence, block_start, block_end, block_text, metadata."""
    one = found.select(id_col, "section", "page", "page_count", "text", F.explode("blocks").alias("b"))
    return one.select(
        id_col, "section", "page", "page_count", F.col("b.kind").alias("kind"), F.array_join("b.path", "/").alias("path"), F.col("b.confidence").alias("confidence"),
        F.col("b.start").alias("block_start"), F.col("b.end").alias("block_end"), F.substring(F.col("text"), F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("block_text"), F.col("b.metadata").alias("metadata"),
    )
