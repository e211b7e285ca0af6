"""Structure of paged and flowing documents against what is written out by hand and against a plain reader of the standard library."""

from __future__ import annotations

import random
from xml.etree import ElementTree

import pytest

from loreweave.operators import chunking
from loreweave.operators.splitting import Limits
from loreweave.sources import structure


def short(section):
    """kind, text, path of a section's blocks."""
    return [(b[0], section[1][b[1] : b[2]], "/".join(b[3])) for b in section[6]]


def test_headings_paragraphs_and_lists():
    page = '<html><body><h2>A\xa0b</h2><p class="x">1. one</p><h1>C</h1><p>•  two</p><h3>D\nd</h3><p>-no</p><p> \n </p><em>e</em></body></html>'
    (section,) = structure.parsed(page, "DOCX")
    assert short(section) == [
        ("HEADING", "A b", "body/heading[1]/heading[2]:A b"), ("PARAGRAPH", "1. one", "body/heading[1]/heading[2]:A b/paragraph"), ("HEADING", "C", "body/heading[1]:C"), ("PARAGRAPH", "•  two", "body/heading[1]:C/paragraph"),
        ("HEADING", "D\nd", "body/heading[1]:C/heading[2]/heading[3]:D d"), ("PARAGRAPH", "-no", "body/heading[1]:C/heading[2]/heading[3]:D d/paragraph"), ("TEXT", "e", "body/heading[1]:C/heading[2]/heading[3]:D d/unrecognized[em]"),
    ]
    assert section[1] == "A b\n1. one\nC\n•  two\nD\nd\n-no\ne"
    assert [b[5] for b in section[6]][:4] == [{"level": "2"}, {"styleClass": "x", "styleConfidence": "HINT", "listMarker": "1.", "listConfidence": "HINT"}, {"level": "1"}, {"listMarker": "•", "listConfidence": "HINT"}]


def test_tables():
    page = "<html><body><table><tr><td><p>a</p><b>b</b></td><th>c</th></tr><tr/><tr><td/></tr><tr><td>d</td></tr></table><table>bare</table></body></html>"
    (section,) = structure.parsed(page, "DOCX")
    t = "body/table[1]"
    assert short(section) == [
        ("TABLE", "a\nb\nc\nd", t), ("TABLE_ROW", "a\nb\nc", f"{t}/row[1]"), ("TABLE_CELL", "a\nb", f"{t}/row[1]/cell[1]"), ("PARAGRAPH", "a", f"{t}/row[1]/cell[1]/paragraph"), ("TEXT", "b", f"{t}/row[1]/cell[1]/unrecognized[b]"),
        ("TEXT", "c", f"{t}/row[1]/cell[2]"), ("TABLE_CELL", "c", f"{t}/row[1]/cell[2]"), ("TEXT", "d", f"{t}/row[4]/cell[1]"), ("TABLE_CELL", "d", f"{t}/row[4]/cell[1]"), ("TABLE_ROW", "d", f"{t}/row[4]"), ("TEXT", "bare", "body/table[2]/unrecognized[table]"),
    ]


def test_pages():
    page = '<html><body><div class="page first"><p>one\n\ntwo</p><h1>x</h1></div><div class="page">bare</div><div class="pages"><p>none</p></div><div class="page"><p/></div></body></html>'
    found = structure.parsed(page, "PDF")
    assert [(s[0], s[1], s[2], s[3]) for s in found] == [(0, "one\n\ntwo\nx", 1, 3), (1, "bare", 2, 3), (2, "", 3, 3)]
    assert short(found[0]) == [("PAGE", "one\n\ntwo\nx", "page[1]"), ("PARAGRAPH", "one\n\ntwo", "page[1]/paragraph"), ("LINE", "one", "page[1]/line[1]"), ("LINE", "two", "page[1]/line[2]"), ("TEXT", "x", "page[1]/unrecognized[h1]")]
    assert short(found[1]) == [("TEXT", "bare", "page[2]/text"), ("PAGE", "bare", "page[2]")] and found[2][6] == []
    assert [s[2] for s in structure.parsed(page, "PDF", max_pages=2)] == [1, 2] and len(structure.parsed(page, "PDF", max_pages=0)) == 3
    (one,) = structure.parsed(page, "PDF", split_pages=False, max_pages=2)
    assert (one[1], one[2], one[3]) == ("one\n\ntwo\nx\nbare", None, None)
    assert structure.parsed("<html/>", "PDF") == [] and structure.parsed("<html/>", "PDF", split_pages=False)[0][1] == ""


def test_hardened():
    bomb = '<!DOCTYPE html [<!ENTITY a "b">]><html><body><p>&a;</p></body></html>'
    assert [structure.parsed(t, "DOCX")[0][7] for t in (bomb, "<html><body>", "", None, "<a>&b;</a>")] == ["DOCTYPE", "NOT_WELL_FORMED", "NOT_WELL_FORMED", "NOT_WELL_FORMED", "NOT_WELL_FORMED"]


def test_any_html():
    page = "<!DOCTYPE html><title>t</title><script>s</script><div>lead<h1>A</h1><div><p>one<p>two<br>more</div></div><table><tr><td>c<td>d<tr><td>e</table></nope>tail"
    (section,) = structure.parsed(page, "DOCX", strict=False)
    assert [(k, t) for k, t, _ in short(section) if k not in ("TABLE", "TABLE_ROW", "TABLE_CELL")] == [("TEXT", "lead"), ("HEADING", "A"), ("PARAGRAPH", "one"), ("PARAGRAPH", "twomore"), ("TEXT", "c"), ("TEXT", "d"), ("TEXT", "e"), ("TEXT", "tail")]
    assert [t for k, t, _ in short(section) if k == "TABLE_ROW"] == ["c\nd", "e"]
    deep = "<div>" * 5000 + "<p>x</p>"
    assert [t for _, t, _ in short(structure.parsed(deep, "DOCX", strict=False)[0])] == ["x"]


def test_leaves_against_a_plain_reader():
    """Leaves are the paragraphs and headings that the standard library's reader gives, whatever the order of elements."""
    rng = random.Random(3)
    for _ in range(30):
        inner = "".join(rng.choice(["<p>w{0} &amp; <b>v</b></p>", "<h1>h{0}</h1>", "<h4>i{0}</h4>", "<p> </p>", "<ul><li>l{0}</li></ul>"]).format(k) for k in range(rng.randrange(20)))
        page = f"<html><body>{inner}</body></html>"
        (section,) = structure.parsed(page, "DOCX")
        want = [t for x in ElementTree.fromstring(page)[0] if (t := "".join(x.itertext()).strip())]
        assert [t for _, t, _ in short(section)] == want and section[1] == "\n".join(want)


def test_sections_into_chunks(spark):
    """Pages become sections, their paragraphs bound the chunks, every chunk is its stretch of a page, and bad or empty documents have no chunks."""
    body = "".join(f'<div class="page"><p>{" ".join(f"w{p}x{k}" for k in range(40))}</p><p>End of {p}.</p></div>' for p in range(3))
    docs = spark.createDataFrame([(1, f"<html><body>{body}</body></html>"), (2, "<html>"), (3, None), (4, '<a class="page"/>')], "doc_id long, xhtml string")
    found = structure.sections(docs, "PDF").cache()
    rows = {(r.doc_id, r.section): r for r in found.collect()}
    assert sorted(rows, key=repr) == sorted([(1, 0), (1, 1), (1, 2), (2, None), (3, None), (4, 0)], key=repr) and rows[2, None].error == "NOT_WELL_FORMED" and rows[4, 0].blocks == []
    assert rows[1, 0].blocks[0].metadata == {"pageNumber": "1"}
    chunks = [r for r in chunking.section_chunks(found.where("error is null"), Limits(tokens=120, overlap=0, characters=120)).collect() if r.kind == "CHILD"]
    assert {r.doc_id for r in chunks} == {1} and {r.page_start for r in chunks} == {1, 2, 3}
    assert all(r.chunk_text == rows[1, r.section].text[r.source_start : r.source_end] and len(r.chunk_text) <= 120 for r in chunks)
    with pytest.raises(ValueError, match="unknown kind"):
        structure.sections(docs, "TXT")
