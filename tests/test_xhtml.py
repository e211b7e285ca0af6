"""Sections of pages whose head has no end tag."""

from __future__ import annotations

from loreweave.sources import xhtml


def test_a_head_without_an_end_tag():
    want = [("HEADING", "One"), ("PARAGRAPH", "Some text.")]
    for head in ("<head><title>x</title></head>", "<head><title>x</title>", "<head><meta charset=utf-8><title>x</title><script>var a</script>"):
        for body in ("<body>", ""):
            rows = xhtml.blocks(f"<html>{head}{body}<h1>One</h1><p>Some text.</p>")
            assert [(r[2], r[4]) for r in rows] == want, head
