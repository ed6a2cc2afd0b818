"""A JSON Schema (draft 2020-12) for the JSON form, made from the element types and their columns."""

from __future__ import annotations

import json
from typing import Any

from quire.schema import FIELD_TYPES

_TEXT, _INT, _BOOL, _NUM = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "number"}
_BOX = {"type": "array", "items": _INT, "minItems": 4, "maxItems": 4}


def _maybe(kind: dict) -> dict:
    return {"anyOf": [kind, {"type": "null"}]}


def _object(fields: dict[str, dict], required: tuple[str, ...] = (), more: bool = False) -> dict:
    return {"type": "object", "properties": fields, "required": list(required), "additionalProperties": more}


_SHARED = {"id": _TEXT, "bbox": _BOX, "confidence": _NUM, "page": _INT, "reading_order": _INT, "lang": _TEXT, "is_furniture": _BOOL}
_SPAN = {"type": "integer", "minimum": 1}
_CELL = _object({"text": _TEXT, "bbox": _maybe(_BOX), "is_header": _BOOL, "colspan": _SPAN, "rowspan": _SPAN}, ("text",))
_ROW = _object({"is_header": _BOOL, "bbox": _maybe(_BOX), "cells": {"type": "array", "items": _CELL}}, ("cells",))
_CHILD = {"text": _TEXT, "checked": _BOOL}
_ITEM = _object({**_CHILD, "children": {"type": "array", "items": _object(_CHILD, ("text",))}}, ("text",))

OWN: dict[str, dict[str, dict]] = {
    "heading": {"level": {"type": "integer", "minimum": 1, "maximum": 6}, "text": _TEXT},
    "paragraph": {"text": _TEXT},
    "blockquote": {"text": _TEXT},
    "horizontalrule": {},
    "pagebreak": {"from_page": _INT, "to_page": _INT},
    "table": {"table_id": _maybe(_TEXT), "caption": _maybe(_TEXT), "nested": _BOOL, "page_range": {"type": "array", "items": _INT, "minItems": 2, "maxItems": 2}, "continuation_of": _TEXT, "rows": {"type": "array", "items": _ROW}},
    "codeblock": {"language": _maybe(_TEXT), "code": _TEXT},
    "mathblock": {"expression": _TEXT, "display_mode": _BOOL},
    "formfield": {"field_name": _TEXT, "field_type": {"enum": list(FIELD_TYPES)}, "value": _TEXT},
    "chart": {"chart_type": _TEXT, "data_ref": _maybe(_TEXT), "x_field": _maybe(_TEXT), "y_field": _maybe(_TEXT), "extra": {"type": "object"}},
    "annotation": {"annotation_type": _TEXT, "text": _TEXT},
    "keyvaluepair": {"key": _TEXT, "value": _TEXT},
    "figure": {"caption": _TEXT, "source": _TEXT, "figure_id": _maybe(_TEXT), "image_type": _TEXT, "image_data": _TEXT},
    "footnote": {"number": {"type": "integer", "minimum": 0}, "text": _TEXT},
    "listblock": {"ordered": _BOOL, "start": _SPAN, "items": {"type": "array", "items": _ITEM}},
    "crossref": {"ref_type": _TEXT, "ref_id": _TEXT},
}
OPTIONAL = {"page_range", "continuation_of", "extra", "image_type", "image_data"}


def json_schema() -> dict[str, Any]:
    one_of = []
    for name, own in OWN.items():
        shared = {} if name == "pagebreak" else _SHARED
        one_of.append(_object({"type": {"const": name}, **shared, **own}, ("type", *(k for k in own if k not in OPTIONAL))))
    front = _object({"version": _TEXT, "source": _TEXT, "pages": {"type": "integer", "minimum": 1}, "lang": _TEXT, "doc_type": _TEXT}, (), True)
    note = _object({"text": _TEXT, "bbox": _maybe(_BOX), "cell_bboxes": _maybe({"type": "array", "items": _BOX})}, ("text",))
    spatial = _object({"page": _INT, "grid": _TEXT, "annotations": {"type": "array", "items": note}}, ("page",))
    top = _object(
        {"dox_version": {"enum": ["1.0", "0.1"]}, "frontmatter": front, "elements": {"type": "array", "items": {"oneOf": one_of}}, "spatial": {"type": "array", "items": spatial}, "metadata": _object({}, (), True)},
        ("elements",),
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Structured document", **top}


def json_schema_text(indent: int = 2) -> str:
    return json.dumps(json_schema(), indent=indent)
