"""Types of the corpus tables."""

from __future__ import annotations

BBOX = "struct<x1:int,y1:int,x2:int,y2:int>"
CELL = "struct<text:string,is_header:boolean,colspan:int,rowspan:int>"
ROW = f"struct<is_header:boolean,cells:array<{CELL}>>"
CHILD = "struct<text:string,checked:boolean>"
ITEM = f"struct<text:string,checked:boolean,children:array<{CHILD}>>"

#: Columns of an element, in order; a type uses its own and leaves the others null.
ELEMENT: dict[str, str] = {
    "pos": "int", "etype": "string", "element_id": "string", "page": "int", "confidence": "double", "reading_order": "int",
    "lang": "string", "is_furniture": "boolean", "bbox": BBOX, "level": "int", "text": "string", "code": "string",
    "language": "string", "expression": "string", "display_mode": "boolean", "key": "string", "value": "string",
    "field_name": "string", "field_type": "string", "chart_type": "string", "data_ref": "string", "x_field": "string",
    "y_field": "string", "extra": "map<string,string>", "annotation_type": "string", "ref_type": "string", "ref_id": "string",
    "caption": "string", "source": "string", "figure_id": "string", "image_data": "string", "image_type": "string",
    "number": "int", "ordered": "boolean", "start": "int", "from_page": "int", "to_page": "int", "table_id": "string",
    "nested": "boolean", "page_range": "struct<start:int,end:int>", "continuation_of": "string",
    "rows": f"array<{ROW}>", "items": f"array<{ITEM}>",
}
ANNOTATION = f"struct<line_text:string,bbox:{BBOX},cell_bboxes:array<{BBOX}>>"
SPATIAL = f"struct<page:int,grid_w:int,grid_h:int,annotations:array<{ANNOTATION}>>"
ELEMENT_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in ELEMENT.items()) + ">"
PARSED = f"front string, elements array<{ELEMENT_STRUCT}>, spatial array<{SPATIAL}>, meta string, notes array<string>"

#: Element types by their name in the JSON form.
TYPES = (
    "heading", "paragraph", "table", "mathblock", "blockquote", "horizontalrule", "keyvaluepair", "codeblock", "formfield",
    "chart", "annotation", "crossref", "figure", "footnote", "listblock", "pagebreak",
)
FIELD_TYPES = ("text", "checkbox", "radio", "select", "textarea")
