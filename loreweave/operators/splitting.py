"""The recursive splitter and the parents of its chunks: plain functions over one document, run inside tasks.

Offsets are code points. A section is first cut into bounds: its structural blocks and the gaps between them, then, where such a
piece is over the limits, the finest bounds needed (paragraph, line, sentence, word, character). Chunks are windows over those
pieces. Lengths in tokens come from running sums where the estimator counts bytes, so no piece is encoded twice.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np


def utf8_tokens(text: str) -> int:
    return len(text.encode())


@dataclass(frozen=True)
class Limits:
    """Token and character limits of children and parents; header budgets are taken off the children's."""

    tokens: int = 800
    overlap: int = 80
    characters: int = 4000
    parent_tokens: int = 1600
    parent_characters: int = 8000
    header_tokens: int = 0
    header_characters: int = 0
    english: bool = False
    parent_pages: int = 2


@dataclass(frozen=True)
class Block:
    """A structural block of a section."""

    kind: str
    start: int
    end: int
    path: tuple[str, ...] = ()
    confidence: str | None = None


@dataclass(frozen=True)
class Section:
    text: str
    index: int = 0
    page: int | None = None
    blocks: tuple[Block, ...] = ()
    english: bool = False


class Piece(NamedTuple):
    start: int
    end: int
    tier: int  # place in TIERS
    path: tuple[str, ...] = ()
    confidence: str | None = None


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int
    tier: str
    path: tuple[str, ...] = ()
    confidence: str | None = None
    overlap: int = 0
    section: Section | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Parent:
    text: str
    start: int
    end: int
    first: int  # places of its first and last child
    last: int
    path: tuple[str, ...] = ()
    confidence: str | None = None
    pages: tuple[int | None, int | None] = (None, None)
    merged: bool = False


#: The tiers from coarse to fine, and what ends a piece of each; the separator stays with the piece before it.
LINE_END = r"(?:\r\n|[\n\x0b\x0c\r\x85\u2028\u2029])"
TIERS = ("STRUCTURE", "PARAGRAPH", "LINE", "SENTENCE", "WORD", "CHARACTER")
ENDS = {"PARAGRAPH": re.compile(rf"(?:{LINE_END}\s*){{2,}}"), "LINE": re.compile(LINE_END), "SENTENCE": re.compile(r"(?<=[.!?])\s+"), "WORD": re.compile(r"\s+")}
#: Blocks that only hold others.
HOLDERS = ("PAGE", "TABLE", "TABLE_CELL")


class Ruler:
    """Tokens of stretches of a text."""

    def __init__(self, text: str, count: Callable[[str], int] = utf8_tokens):
        self.text, self.count, self.sums = text, count, None
        if count is utf8_tokens:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            self.sums = np.concatenate([[0], np.cumsum(width)]).tolist()

    def tokens(self, a: int, b: int) -> int:
        return self.sums[b] - self.sums[a] if self.sums else self.count(self.text[a:b])

    def reach(self, a: int, b: int, tokens: int) -> int:
        """The end of the longest stretch from a, up to b, that holds at most tokens; one code point at least."""
        if self.sums:
            return max(a + 1, min(b, bisect.bisect_right(self.sums, self.sums[a] + tokens, a, b + 1) - 1))
        return max(a + 1, a + bisect.bisect_right(range(1, b - a + 1), tokens, key=lambda n: self.count(self.text[a : a + n])))


def structural_bounds(size: int, blocks: tuple[Block, ...]) -> list[Piece]:
    """The blocks that hold text themselves, by their start, without those that begin inside one before; gaps are pieces of no path."""
    out, at = [], 0
    for b in sorted((b for b in blocks if b.kind not in HOLDERS), key=lambda b: b.start):
        if b.start >= at:
            out += [Piece(at, b.start, 0)] * (b.start > at) + [Piece(b.start, b.end, 0, b.path, b.confidence)]
            at = b.end
    return out + [Piece(at, size, 0)] * (at < size)


def bounded(ruler: Ruler, piece: Piece, tokens: int, characters: int, english: bool) -> list[Piece]:
    """piece, or the pieces it falls into at the tiers it takes to fit."""
    out, todo = [], [(piece.start, piece.end, 0, 1)]  # start, end, tier that made it, tier to try next
    while todo:
        a, b, made, tier = todo.pop()
        if b - a <= characters and ruler.tokens(a, b) <= tokens:
            out.append(Piece(a, b, made, piece.path, piece.confidence))
        elif TIERS[tier] == "CHARACTER":
            while a < b:
                end = ruler.reach(a, min(b, a + characters), tokens)
                out.append(Piece(a, end, tier, piece.path, piece.confidence))
                a = end
        elif TIERS[tier] == "SENTENCE" and not english:
            todo.append((a, b, made, tier + 1))
        else:
            cuts = [a, *(m.end() for m in ENDS[TIERS[tier]].finditer(ruler.text, a, b) if a < m.end() < b), b]
            todo += [(x, y, tier if len(cuts) > 2 else made, tier + 1) for x, y in reversed(list(zip(cuts, cuts[1:], strict=False)))]
    return out


def split(section: Section, limits: Limits, count: Callable[[str], int] = utf8_tokens) -> list[Chunk]:
    """The chunks of a section: each takes pieces while the stretch from its first to its last fits both limits. The next one opens
    with as many whole pieces of the last as the overlap allows, if that held two or more and they leave room for a new piece."""
    if not section.text.strip():
        return []
    tokens, characters = max(1, limits.tokens - limits.header_tokens), max(1, limits.characters - limits.header_characters)
    ruler = Ruler(section.text, count)
    pieces = [p for unit in structural_bounds(len(section.text), section.blocks) for p in bounded(ruler, unit, tokens, characters, limits.english or section.english)]

    def fits(i: int, j: int, most: int = tokens) -> bool:
        """Do pieces i to j, the last included, fit?"""
        a, b = pieces[i].start, pieces[j].end
        return b - a <= characters and ruler.tokens(a, b) <= most

    out, first, carried = [], 0, 0
    while first < len(pieces):
        after = first + 1
        while after < len(pieces) and fits(first, after):
            after += 1
        own = pieces[first:after]
        known = next((p for p in own if p.path or p.confidence), own[0])
        out.append(Chunk(own[0].start, own[-1].end, TIERS[max(p.tier for p in own)], known.path, known.confidence, carried, section))
        if after == len(pieces):
            break
        start, carried = after, 0
        if limits.overlap and len(own) > 1:
            start = next((k for k in range(first + 1, after) if fits(k, after - 1, limits.overlap) and fits(k, after)), after)
            carried = ruler.tokens(pieces[start].start, own[-1].end) if start < after else 0
        first = start
    return out


def parents(chunks: list[Chunk], limits: Limits, count: Callable[[str], int] = utf8_tokens, merge_pages: bool = False) -> list[Parent]:
    """Runs of chunks of one section whose path is that of the run's first, or none on either side, while the stretch of the source
    that they span fits the parents' limits. A parent's text is that stretch."""
    runs: list[list[int]] = []
    rulers: dict[int, Ruler] = {}
    for k, chunk in enumerate(chunks):
        ruler = rulers.get(id(chunk.section))
        if ruler is None:  # one for a section, whatever the number of its chunks
            ruler = rulers[id(chunk.section)] = Ruler(chunk.section.text, count)
        head = chunks[runs[-1][0]] if runs else None
        same = head is not None and head.section is chunk.section and (not head.path or not chunk.path or head.path == chunk.path)
        if same and chunk.end - head.start <= limits.parent_characters and ruler.tokens(head.start, chunk.end) <= limits.parent_tokens:
            runs[-1].append(k)
        else:
            runs.append([k])
    out = []
    for run in runs:
        own = [chunks[k] for k in run]
        page, a, b = own[0].section.page, own[0].start, own[-1].end
        path = next((c.path for c in own if c.path), ())
        out.append(Parent(own[0].section.text[a:b], a, b, run[0], run[-1], path, next((c.confidence for c in own if c.confidence), None), (page, page)))
    return across_pages(out, limits, count) if merge_pages and limits.parent_pages > 1 else out


def across_pages(found: list[Parent], limits: Limits, count: Callable[[str], int] = utf8_tokens) -> list[Parent]:
    """Parents of neighbouring pages joined in pairs: the second page follows the first, both have one path and are sure of it, and
    the joined text fits. A parent is joined once."""
    out: list[Parent] = []
    for x in found:
        if out and (last := out[-1]).pages[1] is not None and x.pages[0] == last.pages[1] + 1 and not last.merged:
            text = f"{last.text}\n{x.text}"
            sure = last.confidence == x.confidence == "AUTHORITATIVE" and last.path and last.path == x.path
            if sure and len(text) <= limits.parent_characters and count(text) <= limits.parent_tokens:
                out[-1] = Parent(text, last.start, x.end, last.first, x.last, last.path, last.confidence, (last.pages[0], x.pages[1]), True)
                continue
        out.append(x)
    return out


def header(text: str, limits: Limits, revision: str, count: Callable[[str], int] = utf8_tokens, source: str | None = None, kind: str | None = None, path: tuple[str, ...] = (), pages: tuple[int | None, int | None] = (None, None), page_count: int | None = None) -> str:
    """What stands before a chunk's text for its embedding: fields in order, each at most 160 characters, taken while the header keeps
    to its own budget and to what the text leaves of the chunk's; empty if no field fits."""
    tokens, characters = min(limits.header_tokens, max(0, limits.tokens - count(text))), min(limits.header_characters, max(0, limits.characters - len(text)))
    page = None
    if pages[0] is not None:
        page = (f"{pages[0]}" if pages[0] == pages[1] else f"{pages[0]}-{pages[1]}") + (f"/{page_count}" if page_count is not None else "")
    fields = (("source", source), ("format", kind), ("path", " > ".join(path)), ("page", page))
    written = lambda lines: f"[{revision}]\n" + "\n".join(lines) + "\n\n"
    lines: list[str] = []
    for name, value in fields:
        if value and value.strip():
            more = [*lines, f"{name}: {' '.join(value.split())[:160]}"]
            lines = more if len(written(more)) <= characters and count(written(more)) <= tokens else lines
    return written(lines) if lines else ""
