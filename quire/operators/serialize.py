"""Elements back to the layered text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

C = F.col


def _number(x: Column) -> Column:
    return x.cast("string")


def _quoted(name: str, x: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), X.escape_attr(x.cast("string")), F.lit('"'))


def _set(x: Column) -> Column:
    """Null instead of an empty string."""
    return F.when(x != "", x)


def meta_suffix() -> Column:
    """`` {page: …, id: "…", …}`` of the shared fields that are set, or nothing."""
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("page: "), _number(C("page"))),
        F.concat(F.lit('id: "'), X.escape_attr(_set(C("element_id"))), F.lit('"')),
        F.concat(F.lit("confidence: "), _number(C("confidence"))),
        F.concat(F.lit("reading_order: "), _number(C("reading_order"))),
        F.concat(F.lit('lang: "'), X.escape_attr(_set(C("lang"))), F.lit('"')),
        F.when(C("is_furniture"), F.lit("is_furniture: true")),
    )
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit(" {"), parts, F.lit("}")))


def _own_attrs() -> list[Column]:
    return [
        _quoted("page", C("page")),
        _quoted("confidence", C("confidence")),
        _quoted("reading_order", C("reading_order")),
        _quoted("lang", _set(C("lang"))),
        F.when(C("is_furniture"), F.lit('is_furniture="true"')),
    ]


def table_text() -> Column:
    """A table between its marks; a table without header rows begins with the separator, so that
    it is read back as one without."""
    attrs = F.concat_ws(
        " ",
        F.lit("||| table"),
        _quoted("id", _set(C("table_id"))),
        _quoted("caption", _set(C("caption"))),
        F.when(C("nested"), F.lit("nested=true")),
        F.when(C("page_range").isNotNull(), F.concat(F.lit('pages="'), C("page_range.start").cast("string"), F.lit("-"), C("page_range.end").cast("string"), F.lit('"'))),
        _quoted("continuation-of", _set(C("continuation_of"))),
        F.when(C("table_id").isNull() | (C("element_id") != C("table_id")), _quoted("eid", _set(C("element_id")))),
        *_own_attrs(),
    )
    span = lambda c: F.concat_ws(" ", F.when(c["colspan"] > 1, F.concat(F.lit("cs="), c["colspan"].cast("string"))), F.when(c["rowspan"] > 1, F.concat(F.lit("rs="), c["rowspan"].cast("string"))))
    cell = lambda c: F.when(span(c) == "", c["text"]).otherwise(F.concat(c["text"], F.lit(" {"), span(c), F.lit("}")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r["cells"], cell), " | "), F.lit(" |"))
    n = X.num_cols("rows")
    separator = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))
    full = F.concat(F.array(attrs), F.transform(X.header_rows("rows"), line), F.array(separator), F.transform(X.data_rows("rows"), line), F.array(F.lit("|||")))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.concat(attrs, F.lit("\n|||"))).otherwise(F.array_join(full, "\n"))


def item_lines(child_indent: str, sep: str) -> Column:
    """The lines of a list's items and children."""
    box = lambda x: F.when(x["checked"].isNull(), F.lit("")).when(x["checked"], F.lit("[x] ")).otherwise(F.lit("[ ] "))
    mark = lambda number: F.when(C("ordered"), F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("-"))
    first = F.coalesce("start", F.lit(1))
    lines = F.transform(
        "items",
        lambda it, i: F.concat(
            F.array(F.concat(mark(first + i), F.lit(" "), box(it), it["text"])),
            F.transform(it["children"], lambda ch, j: F.concat(F.lit(child_indent), mark(j + 1), F.lit(" "), box(ch), ch["text"])),
        ),
    )
    return F.array_join(F.flatten(lines), sep)


def list_text() -> Column:
    meta = meta_suffix()
    head = F.concat(
        F.lit('::list ordered="'), F.coalesce("ordered", F.lit(False)).cast("string"), F.lit('"'),
        F.when(C("ordered"), F.concat(F.lit(' start="'), F.coalesce("start", F.lit(1)).cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.lit("::"), meta,
    )
    body = item_lines("  ", "\n")
    plain = (F.size("items") > 0) & (F.coalesce("start", F.lit(1)) == 1) & (meta == "")
    return F.when(plain, body).otherwise(F.concat_ws("\n", head, _set(body)))


def element_text() -> Column:
    """One element as text, by its type."""
    text, meta, attr = F.coalesce(C("text"), F.lit("")), meta_suffix(), X.escape_attr
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    opt = lambda name, c: F.when(F.coalesce(C(c), F.lit("")) != "", F.concat(F.lit(f' {name}="'), attr(C(c)), F.lit('"')))
    hints = F.concat_ws(
        ", ", F.when(C("display_mode"), F.lit("math: latex")), F.concat(F.lit("page: "), _number(C("page"))),
        F.concat(F.lit('id: "'), attr(_set(C("element_id"))), F.lit('"')), F.concat(F.lit("confidence: "), _number(C("confidence"))),
    )
    figure = F.concat_ws(", ", _quoted("id", _set(C("figure_id"))), _quoted("eid", _set(C("element_id"))), *_own_attrs(), _quoted("image_type", C("image_type")), _quoted("image_data", C("image_data")))
    forms: dict[str, Column] = {
        "heading": said(F.repeat(F.lit("#"), X.clamp(C("level"), 1, 6)), " ", text, meta),
        "paragraph": said(text, meta),
        "blockquote": said("> ", F.replace(text, F.lit("\n"), F.lit("\n> ")), meta),
        "table": table_text(),
        "codeblock": said("```", C("language"), meta, "\n", C("code"), "\n```"),
        "mathblock": said("$$", C("expression"), "$$", F.when(hints != "", F.concat(F.lit(" {"), hints, F.lit("}")))),
        "formfield": said('::form field="', attr(C("field_name")), '" type="', C("field_type"), '" value="', attr(C("value")), '"::', meta),
        "chart": said('::chart type="', attr(C("chart_type")), '"', opt("data-ref", "data_ref"), opt("x", "x_field"), opt("y", "y_field"), "::", meta),
        "annotation": said('::annotation type="', attr(C("annotation_type")), '"', F.concat(F.lit(" confidence="), _number(C("confidence"))), ' text="', attr(C("text")), '"::', meta),
        "keyvaluepair": said('::kv key="', attr(C("key")), '" value="', attr(C("value")), '"::', meta),
        "figure": said("![", X.escape_chars("caption", "[]"), "](", X.escape_chars("source", "()"), ")", F.when(figure != "", F.concat(F.lit(" {figure: "), figure, F.lit("}")))),
        "footnote": said("[^", C("number"), "]: ", text, meta),
        "listblock": list_text(),
        "crossref": said("[[ref:", C("ref_type"), ":", C("ref_id"), "]]", meta),
        "horizontalrule": F.lit("---"),
        "pagebreak": said("---page-break from=", C("from_page"), " to=", C("to_page"), "---"),
    }
    return by_type(forms)


def by_type(forms: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, form in reversed(forms.items()):
        out = F.when(C("etype") == name, form).otherwise(out)
    return out


def content(els: DataFrame) -> DataFrame:
    """(doc_id, text): the elements of each document as text, blank lines between. One row for
    each element moves, as text, to its document; nothing moves where they are already together."""
    lines = els.select("doc_id", "pos", element_text().alias("s")).where("s IS NOT NULL")
    return lines.groupBy("doc_id").agg(X.joined_in_order(C("s"), C("pos"), "\n\n").alias("text"))


def spatial(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the spatial layer."""
    box = lambda b: F.concat(F.lit("@["), F.concat_ws(",", b["x1"], b["y1"], b["x2"], b["y2"]), F.lit("]"))
    line = lambda a: F.concat_ws(" ", _set(a["line_text"]), F.when(a["bbox"].isNotNull(), box(a["bbox"])), F.when(F.size(a["cell_bboxes"]) > 0, F.concat(F.lit("cells=["), F.array_join(F.transform(a["cell_bboxes"], box), ","), F.lit("]"))))
    head = F.concat(F.lit("---spatial page="), C("page").cast("string"), F.lit(" grid="), C("grid_w").cast("string"), F.lit("x"), C("grid_h").cast("string"))
    block = F.array_join(F.concat(F.array(head), F.transform("annotations", line), F.array(F.lit("---/spatial"))), "\n")
    return blocks.select("doc_id", "block_idx", block.alias("s")).groupBy("doc_id").agg(X.joined_in_order(C("s"), C("block_idx"), "\n\n").alias("text"))


def yaml_of(json_text: Column) -> Column:
    """A JSON object as YAML: JSON's flow style is YAML already."""
    return F.coalesce(json_text, F.lit("{}"))


def serialize(parsed_docs: DataFrame, with_spatial: bool = True, with_metadata: bool = True) -> DataFrame:
    """(doc_id, text): whole documents, all layers; dropping a layer is what stripping is."""
    els = parsed_docs.select("doc_id", F.inline_outer("elements")).where("etype IS NOT NULL")
    out = parsed_docs.select("doc_id", F.concat(F.lit("---dox\n"), yaml_of(C("front")), F.lit("\n---\n")).alias("head"), C("meta").alias("m"))
    out = out.join(content(els).withColumnRenamed("text", "body"), "doc_id", "left")
    parts = [C("head"), C("body")]
    if with_spatial:
        blocks = parsed_docs.select("doc_id", F.posexplode("spatial").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")
        out = out.join(spatial(blocks).withColumnRenamed("text", "boxes"), "doc_id", "left")
        parts.append(C("boxes"))
    if with_metadata:
        parts.append(F.when(C("m").isNotNull(), F.concat(F.lit("---meta\n"), yaml_of(C("m")), F.lit("\n---/meta"))))
    return out.select("doc_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("text"))
