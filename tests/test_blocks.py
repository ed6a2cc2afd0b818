"""The block grammar, on documents of our own."""

import pytest

from quire.operators.blockscan import attributes, meta_of, parsed, split_meta, unescaped


def kinds(text):
    return [e["etype"] for e in parsed(text)["elements"]]


def only(text):
    (e,) = parsed(text)["elements"]
    return {k: v for k, v in e.items() if v is not None}


def test_paragraph_absorbs_rules_and_bare_math_but_not_blocks():
    assert only("one\ntwo\n---\n$$\nthree")["text"] == "one two --- $$ three"
    assert kinds("---\none\n# two") == ["horizontalrule", "paragraph", "heading"]
    assert kinds("--\n**\n- - -") == ["horizontalrule"] * 3


def test_heading_meta_and_box():
    e = only('## Title @[1,2,3,4] {page: 2, id: "a\\"b", confidence: 0.5, lang: "en", is_furniture: true}')
    assert (e["level"], e["text"], e["page"], e["element_id"], e["confidence"]) == (2, "Title @[1,2,3,4]", 2, 'a"b', 0.5)
    assert e["bbox"] == {"x1": 1, "y1": 2, "x2": 3, "y2": 4} and e["is_furniture"]
    assert only("x {nothing known}")["text"] == "x {nothing known}"
    assert split_meta("t {homepage: 3}") == ("t", {"page": 3})


@pytest.mark.parametrize(("text", "code"), [("```py\na\n```", "a"), ("```\na\n\nb", "a\n\nb"), ("```\n```", "")])
def test_code(text, code):
    assert only(text)["code"] == code


def test_bare_fence_opens_and_closes():
    assert kinds("```\nx\n```\ny\n```\nz") == ["codeblock", "paragraph", "codeblock"]


def test_table_headers_spans_and_end():
    t = only('||| table id="t" caption="a \\"b\\"" pages="2-4" nested=true\n| h | k {cs=2 rs=3} |\n|---|---|\n| 1 | 2 {cs=0} |\n| - | : |\n|||')
    assert t["caption"] == 'a "b"' and t["page_range"] == {"start": 2, "end": 4} and t["nested"] and t["element_id"] == "t"
    assert [r["is_header"] for r in t["rows"]] == [True, False]  # a row of marks alone is a separator
    assert [(c["colspan"], c["rowspan"]) for c in t["rows"][0]["cells"]] == [(1, 1), (2, 3)]
    assert t["rows"][1]["cells"][1]["colspan"] == 1
    assert len(only("||| table\n| a |\n\n# not a heading")["rows"]) == 1


def test_lists():
    e = only("- a\n  - [x] b\n      - c\n- [ ] d")
    assert [(i["text"], i["checked"], [c["text"] for c in i["children"]]) for i in e["items"]] == [("a", None, ["b", "c"]), ("d", False, [])]
    assert only("3. a\n4. b")["start"] == 3
    assert only('::list ordered="true" start="5"::\n1. a')["start"] == 5
    assert only("::list ordered=false start=5::")["items"] == []
    assert kinds("  - a\n- b") == ["listblock", "listblock"]


def test_inline_blocks():
    assert only('::kv key="a::b" value="c \\"d\\""::')["value"] == 'c "d"'
    assert only('::form field="f" type="strange" value="v"::')["field_type"] == "text"
    assert only('::chart type="pie" data-ref="t" more="m"::')["extra"] == [("more", "m")]
    assert kinds('::unknown a="b"::') == []
    assert kinds('::kv key="a"::  trailing') == ["paragraph"]


def test_other_blocks():
    assert only("[[ref:table:t1]]")["ref_id"] == "t1" and only("[[ref:t1]]")["ref_type"] == ""
    assert kinds("see [[ref:table:t1]]") == ["paragraph"]
    assert only("![a \\] b](x\\)y)")["source"] == "x)y"
    assert only("[^7]: note")["number"] == 7
    assert only("$$a+b$$ dropped")["expression"] == "a+b"
    assert only("$$\na\nb\n$$")["expression"] == "a\nb"
    assert only("> a\n> b")["text"] == "a b"
    assert only("---page-break from=1 to=2---")["to_page"] == 2


def test_layers():
    p = parsed("text\n\n---dox\nversion: '1.0'\nother: [1, 2]\n---\n---spatial page=x grid=10x20\nline @[1,2,3,4]\n---/spatial\n---meta\n- a list\n---/meta")
    assert '"other": [1, 2]' in p["front"] and p["notes"] == ["metadata: not a mapping"]
    assert p["spatial"][0]["page"] == 0 and p["spatial"][0]["grid_h"] == 20 and p["spatial"][0]["annotations"][0]["line_text"] == "line"
    assert [e["text"] for e in p["elements"]] == ["text"]
    assert parsed("---dox\n: bad: [\n---\nx")["notes"] == ["frontmatter: not valid YAML"]
    assert parsed(None)["elements"] == [] and parsed("")["elements"] == []


def test_small_parts():
    assert unescaped("a\\\\b\\nc\\") == "a\\bnc\\"
    assert attributes('a="1" a=2 b=3') == {"a": "1", "b": "3"}
    assert meta_of('page: 1, id: "x"') == {"page": 1, "element_id": "x"}
