"""The block grammar: one document's lines to its elements.

Which block a line belongs to depends on the blocks before it (a bare fence both opens and
closes; a table runs to its end mark, or to the end of the text), so a document is scanned in
order. Rules are tried in a fixed order at each line that begins a block; each rule is a
function of the scanner that returns an element and the line to go on at, or None. Documents
are independent of one another: the scan runs in Arrow batches, with no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import yaml

Found = tuple[dict, int] | None

# The patterns of the format.
FRONT = re.compile(r"^---dox\s*\n(.*?)\n---\s*$", re.M | re.S)
SPATIAL = re.compile(r"^---spatial\s+(.*?)\n(.*?)\n---/spatial\s*$", re.M | re.S)
META = re.compile(r"^---meta\s*\n(.*?)\n---/meta\s*$", re.M | re.S)
RULE = re.compile(r"^([-*_])\s*(\1\s*)+$")
BREAK = re.compile(r"^---page-break\s+from=(\d+)\s+to=(\d+)\s*---$")
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
FENCE = re.compile(r"^```(?:([^\s{]+))?(?:\s+(\{.*\}))?\s*$")
FENCE_END = re.compile(r"^```\s*$")
TABLE = re.compile(r"^\|\|\|\s*table\s*(.*)?$")
TABLE_END = re.compile(r"^\|\|\|\s*$")
ROW = re.compile(r"^\|(.+)\|$")
SEPARATOR = re.compile(r"^[\s|:-]+$")
SPANS = re.compile(r"\{((?:cs=\d+\s*)?(?:rs=\d+\s*)?)\}\s*$")
REF = re.compile(r"^\[\[ref:([^\]]+)\]\]\s*(\{[^}]*\})?\s*$")
FIGURE = re.compile(r"^!\[((?:\\.|[^\]])*)\]\(((?:\\.|[^)])*)\)\s*(?:\{figure:\s*(.*?)\})?\s*$")
NOTE = re.compile(r"^\[\^(\d+)\]:\s*(.+)$")
MATH = re.compile(r"\$\$(.*?)\$\$\s*(\{([^}]*)\})?", re.S)
QUOTE = re.compile(r"^>\s*(.*)")
ITEM = re.compile(r"^(\s*)([-*+]|\d+\.)\s+(.*)$")
TASK = re.compile(r"^(\s*)([-*+])\s+\[([xX ])\]\s*(.*)")
BOX = re.compile(r"@\[(\d+),(\d+),(\d+),(\d+)\]")
CELL_BOXES = re.compile(r"cells=\[(.+)\]\s*$")
QUOTED = re.compile(r'([\w-]+)="((?:\\.|[^"\\])*)"')
UNQUOTED = re.compile(r"([\w-]+)=([^\s]+)")
INLINE = re.compile(r'^::(\w+)(?:::|\s+((?:\\.|"(?:\\.|[^"\\])*"|(?!::)[^"\\])*)::)\s*(\{.*\})?\s*$')
META_KEYS: dict[str, re.Pattern] = {
    "page": re.compile(r'page\s*[:=]\s*"?(\d+)"?'),
    "element_id": re.compile(r'(?:^|[\s,])id\s*[:=]\s*"((?:\\.|[^"\\])*)"'),
    "confidence": re.compile(r'confidence\s*[:=]\s*"?([\d.]+)"?'),
    "reading_order": re.compile(r'reading_order\s*[:=]\s*"?(\d+)"?'),
    "lang": re.compile(r'lang\s*[:=]\s*"((?:\\.|[^"\\])*)"'),
    "is_furniture": re.compile(r'is_furniture\s*[:=]\s*"?(true|false|1|0)"?', re.I),
}
FRONT_KEYS = ("version", "source", "pages", "lang", "doc_type")


def unescaped(text: str) -> str:
    """Drops each backslash that escapes something; a last one alone stays."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def whole(text: str | None, default: int | None = 0) -> int | None:
    """An int, or the default; beyond 32 bits counts as no int."""
    try:
        n = int(text)
    except (TypeError, ValueError):
        return default
    return n if -(2**31) <= n < 2**31 else default


def real(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def truth(text: str | None, default: bool | None = False) -> bool | None:
    word = (text or "").strip().lower()
    return True if word in ("true", "1", "yes") else False if word in ("false", "0", "no") else default


_CONVERT: dict[str, Callable] = {"page": whole, "reading_order": whole, "confidence": real, "is_furniture": truth, "lang": unescaped, "element_id": unescaped}


def meta_of(text: str) -> dict:
    """Known keys in the inside of a {…} suffix."""
    found = {k: _CONVERT[k](m[1]) for k, p in META_KEYS.items() if (m := p.search(text))}
    return {k: v for k, v in found.items() if v is not None}


def split_meta(text: str) -> tuple[str, dict]:
    """A text without its {…} suffix, and what that says; a suffix without a known key is text."""
    bare = text.rstrip()
    at = bare.rfind("{")
    if not bare.endswith("}") or at < 0:
        return text, {}
    meta = meta_of(bare[at + 1 : -1])
    return (bare[:at].rstrip(), meta) if meta else (text, {})


def attributes(text: str) -> dict[str, str]:
    """key="value" pairs; where a key is also given without quotes, the quoted value holds."""
    found = {m[1]: unescaped(m[2]) for m in QUOTED.finditer(text)}
    for m in UNQUOTED.finditer(text):
        found.setdefault(m[1], unescaped(m[2].strip('"')))
    return found


def box_of(m: re.Match | None) -> dict | None:
    return None if m is None else dict(zip(("x1", "y1", "x2", "y2"), (whole(x) for x in m.groups()), strict=True))


class Scanner:
    """The lines of one document without its layers, and the rules of the blocks."""

    def __init__(self, text: str):
        self.lines = text.split("\n")

    def elements(self) -> list[dict]:
        at, out = 0, []
        while at < len(self.lines):
            line = self.lines[at].strip()
            if not line:
                at += 1
                continue
            for rule in RULES:
                if (found := rule(self, at, line)) is not None:
                    element, at = found
                    if element:
                        out.append({"pos": len(out), **element})
                    break
        return out

    def until(self, at: int, end: Callable[[str], object]) -> tuple[list[str], int]:
        """Lines up to one that ends the block or the text, and where to go on."""
        stop = at
        while stop < len(self.lines) and not end(self.lines[stop]):
            stop += 1
        return self.lines[at:stop], stop + 1

    def rule(self, at: int, line: str) -> Found:
        return ({"etype": "horizontalrule"}, at + 1) if RULE.match(line) else None

    def page_break(self, at: int, line: str) -> Found:
        m = BREAK.match(line)
        return m and ({"etype": "pagebreak", "from_page": whole(m[1]), "to_page": whole(m[2])}, at + 1)

    def heading(self, at: int, line: str) -> Found:
        if not (m := HEADING.match(line)):
            return None
        text, meta = split_meta(m[2])
        return {"etype": "heading", "level": len(m[1]), "text": text, "bbox": box_of(BOX.search(text)), **meta}, at + 1

    def code(self, at: int, line: str) -> Found:
        if not (m := FENCE.match(line)):
            return None
        body, then = self.until(at + 1, lambda x: FENCE_END.match(x.strip()))
        return {"etype": "codeblock", "language": m[1], "code": "\n".join(body), **(meta_of(m[2][1:-1]) if m[2] else {})}, then

    def table(self, at: int, line: str) -> Found:
        if not (m := TABLE.match(line)):
            return None
        a = attributes(m[1] or "")
        body, then = self.until(at + 1, lambda x: TABLE_END.match(x.strip()))
        rows, header = [], True
        for each in map(str.strip, body):
            if "|" in each and SEPARATOR.match(each):
                header = False
            elif r := ROW.match(each):
                rows.append({"is_header": header, "cells": [cell(c.strip(), header) for c in r[1].split("|")]})
        pages = re.fullmatch(r"\s*([+-]?\d+)\s*-\s*([+-]?\d+)\s*", a.get("pages", ""))
        table = {
            "etype": "table",
            "table_id": a.get("id"),
            "caption": a.get("caption"),
            "nested": truth(a.get("nested"), "nested" in a),
            "continuation_of": a.get("continuation-of"),
            "page_range": {"start": whole(pages[1]), "end": whole(pages[2])} if pages else None,
            "element_id": a.get("eid") or a.get("id"),
            "rows": rows,
        }
        return table | {k: _CONVERT[k](a[k]) for k in ("page", "confidence", "reading_order", "lang", "is_furniture") if k in a}, then

    def inline(self, at: int, line: str) -> Found:
        if not (m := INLINE.match(line)):
            return None
        kind, a, meta = m[1], attributes(m[2] or ""), meta_of(m[3][1:-1]) if m[3] else {}
        if kind == "list":
            items, ordered, start, then = self.list_body(at + 1)
            is_ordered = truth(a.get("ordered"), ordered)
            first = whole(a.get("start"), start) if is_ordered else 1
            return {"etype": "listblock", "items": items, "ordered": is_ordered, "start": max(first, 1), **meta}, then
        made: dict | None = None
        if kind == "form":
            wanted = a.get("type", "text")
            made = {"etype": "formfield", "field_name": a.get("field", ""), "value": a.get("value", ""), "field_type": wanted if wanted in ("text", "checkbox", "radio", "select", "textarea") else "text"}
        elif kind == "chart":
            more = {k: v for k, v in a.items() if k not in ("type", "data-ref", "x", "y")}
            made = {"etype": "chart", "chart_type": a.get("type", "bar"), "data_ref": a.get("data-ref"), "x_field": a.get("x"), "y_field": a.get("y"), "extra": list(more.items())}
        elif kind == "annotation":
            made = {"etype": "annotation", "annotation_type": a.get("type", "handwriting"), "text": a.get("text", ""), "confidence": real(a.get("confidence"))}
        elif kind == "kv":
            made = {"etype": "keyvaluepair", "key": a.get("key", ""), "value": a.get("value", "")}
        return ({**made, **meta} if made else {}), at + 1

    def cross_ref(self, at: int, line: str) -> Found:
        if not (m := REF.match(line)):
            return None
        kind, colon, name = m[1].partition(":")
        return {"etype": "crossref", "ref_type": kind if colon else "", "ref_id": name if colon else m[1], **(meta_of(m[2][1:-1]) if m[2] else {})}, at + 1

    def figure(self, at: int, line: str) -> Found:
        if not (m := FIGURE.match(line)):
            return None
        a = attributes((m[3] or "").replace('",', '" '))
        figure = {"etype": "figure", "caption": unescaped(m[1]), "source": unescaped(m[2]), "figure_id": a.get("id"), "element_id": a.get("eid"), "image_type": a.get("image_type"), "image_data": a.get("image_data")}
        return figure | {k: _CONVERT[k](a[k].rstrip(",")) for k in ("page", "confidence", "reading_order", "lang", "is_furniture") if k in a}, at + 1

    def footnote(self, at: int, line: str) -> Found:
        if not (m := NOTE.match(line)):
            return None
        text, meta = split_meta(m[2])
        return {"etype": "footnote", "number": whole(m[1]), "text": text, **meta}, at + 1

    def list_block(self, at: int, line: str) -> Found:
        if not ITEM.match(self.lines[at]):
            return None
        items, ordered, start, then = self.list_body(at)
        return {"etype": "listblock", "items": items, "ordered": ordered, "start": start}, then

    def list_body(self, at: int) -> tuple[list[dict], bool, int, int]:
        """Items from a line on: (items, ordered, start, where to go on). What is deeper than the
        first item is a child of the last item; a line less deep ends the list."""
        items, base, ordered, start = [], None, False, 1
        while at < len(self.lines):
            task, plain = TASK.match(self.lines[at]), ITEM.match(self.lines[at])
            m = task or plain
            if not m:
                break
            depth = len(m[1])
            if base is None:
                base = depth
                ordered = bool(plain) and plain[2][0].isdigit()
                start = max(1, whole(plain[2][:-1], 1)) if ordered else 1
            if depth < base:
                break
            item = {"text": task[4] if task else plain[3], "checked": task[3] in "xX" if task else None}
            if depth == base:
                items.append({**item, "children": []})
            else:
                items[-1]["children"].append(item)
            at += 1
        return items, ordered, start, at

    def math_lines(self, at: int, line: str) -> Found:
        if line != "$$":
            return None
        body, then = self.until(at + 1, lambda x: x.strip() == "$$")
        return {"etype": "mathblock", "expression": "\n".join(body).strip(), "display_mode": True}, then

    def math(self, at: int, line: str) -> Found:
        if not (m := MATH.match(line)):
            return None
        return {"etype": "mathblock", "expression": m[1].strip(), "display_mode": True, **(meta_of(m[3]) if m[3] else {})}, at + 1

    def quote(self, at: int, line: str) -> Found:
        if not QUOTE.match(line):
            return None
        parts = []
        while at < len(self.lines) and (m := QUOTE.match(self.lines[at].strip())):
            parts.append(m[1])
            at += 1
        text, meta = split_meta(" ".join(parts))
        return {"etype": "blockquote", "text": text, **meta}, at

    def paragraph(self, at: int, line: str) -> Found:
        """The rest: lines up to a blank one or one that begins a block of another kind. Rules and
        bare $$ begin none here, so a paragraph absorbs them."""
        parts = [line]
        at += 1
        while at < len(self.lines) and (line := self.lines[at].strip()) and not self.breaks(at, line):
            parts.append(line)
            at += 1
        text, meta = split_meta(" ".join(parts))
        return {"etype": "paragraph", "text": text, **meta}, at

    def breaks(self, at: int, line: str) -> bool:
        return bool(
            any(p.match(line) for p in (HEADING, FENCE, TABLE, BREAK, REF, FIGURE, NOTE, QUOTE, INLINE)) or ITEM.match(self.lines[at]) or (line != "$$" and MATH.match(line))
        )


def cell(text: str, header: bool) -> dict:
    spans = {"colspan": 1, "rowspan": 1}
    if m := SPANS.search(text):
        for name, short in (("colspan", "cs"), ("rowspan", "rs")):
            n = re.search(rf"{short}=(\d+)", m[1])
            spans[name] = max(1, whole(n[1])) if n else 1
        text = text[: m.start()].strip()
    return {"text": text, "is_header": header, **spans}


RULES = (
    Scanner.rule, Scanner.page_break, Scanner.heading, Scanner.code, Scanner.table, Scanner.inline, Scanner.cross_ref, Scanner.figure,
    Scanner.footnote, Scanner.list_block, Scanner.math_lines, Scanner.math, Scanner.quote, Scanner.paragraph,
)


def yaml_layer(text: str, name: str, notes: list[str]) -> dict:
    """A YAML layer as a mapping; anything else is noted and counts as empty."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        notes.append(f"{name}: not valid YAML")
        return {}
    if data is not None and not isinstance(data, dict):
        notes.append(f"{name}: not a mapping")
        return {}
    return data or {}


def spatial_block(header: str, body: str) -> dict:
    block = {"page": 1, "grid_w": 1000, "grid_h": 1000, "annotations": []}
    for part in header.split():
        name, _, value = part.partition("=")
        if name == "page":
            block["page"] = whole(value)
        elif name == "grid" and value.count("x") == 1:
            block["grid_w"], block["grid_h"] = map(whole, value.split("x"))
    for line in filter(None, map(str.strip, body.strip().splitlines())):
        first, cells = BOX.search(line), CELL_BOXES.search(line)
        block["annotations"].append(
            {
                "line_text": line[: first.start()].strip() if first else line,
                "bbox": box_of(first),
                "cell_bboxes": [box_of(m) for m in BOX.finditer(cells[1])] if cells else None,
            }
        )
    return block


def parsed(text: str | None) -> dict:
    """All layers of one document."""
    text, notes, front, meta = text or "", [], {}, None
    if m := FRONT.search(text):
        front = yaml_layer(m[1], "frontmatter", notes)
        text = text[: m.start()] + text[m.end() :]
    spatial = [spatial_block(m[1], m[2]) for m in SPATIAL.finditer(text)]
    text = SPATIAL.sub("", text)
    if m := META.search(text):
        meta = yaml_layer(m[1], "metadata", notes)
        text = text[: m.start()] + text[m.end() :]
    return {
        "front": json.dumps(front, default=str, ensure_ascii=False),
        "elements": Scanner(text).elements(),
        "spatial": spatial,
        "meta": None if meta is None else json.dumps(meta, default=str, ensure_ascii=False),
        "notes": notes,
    }
