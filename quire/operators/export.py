"""Elements to JSON, Markdown and HTML; each is one expression for an element and one ordered join of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.serialize import by_type, item_lines

C = F.col


def _said(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def figure_src(column_source: str = "source") -> Column:
    """A figure's source, else its data as a data URI, else nothing."""
    name = F.lower(C("image_type"))
    kind = F.when(name.contains("/"), name).when(name.isin("jpg", "jpeg"), "image/jpeg").when(name == "svg", "image/svg+xml").when(name != "", F.concat(F.lit("image/"), name)).otherwise("image/png")
    data = F.when(C("image_data") != "", _said("data:", F.coalesce(kind, F.lit("image/png")), ";base64,", C("image_data")))
    return F.coalesce(F.when(C(column_source) != "", C(column_source)), data, F.lit(""))


def figure_bytes() -> Column:
    """A figure's data, null if it isn't valid base64."""
    return F.try_to_binary("image_data", F.lit("base64"))


# JSON


def element_json() -> Column:
    """One element as JSON: shared fields only where set, the type's own fields always."""
    text = lambda x: F.when(x.isNull(), F.lit("null")).otherwise(_json_string(x))
    num = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    some = lambda k, c: F.when(C(c) != "", pair(k, text(C(c))))
    box = F.concat(F.lit("["), F.concat_ws(",", C("bbox.x1"), C("bbox.y1"), C("bbox.x2"), C("bbox.y2")), F.lit("]"))
    shared = [
        some("id", "element_id"), F.when(C("bbox").isNotNull(), pair("bbox", box)), F.when(C("confidence").isNotNull(), pair("confidence", num(C("confidence")))),
        F.when(C("page").isNotNull(), pair("page", num(C("page")))), F.when(C("reading_order").isNotNull(), pair("reading_order", num(C("reading_order")))),
        some("lang", "lang"), F.when(C("is_furniture"), F.lit('"is_furniture":true')),
    ]
    t, n = lambda k, c=None: pair(k, text(C(c or k))), lambda k: pair(k, num(C(k)))
    listed = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    cell = lambda c: F.concat(F.lit('{"text":'), text(c["text"]), F.lit(',"bbox":null,"is_header":'), num(c["is_header"]), F.lit(',"colspan":'), num(c["colspan"]), F.lit(',"rowspan":'), num(c["rowspan"]), F.lit("}"))
    row = lambda r: F.concat(F.lit('{"is_header":'), num(r["is_header"]), F.lit(',"bbox":null,"cells":'), listed(F.transform(r["cells"], cell)), F.lit("}"))
    item = lambda i, more: F.concat(F.lit('{"text":'), text(i["text"]), F.when(i["checked"].isNotNull(), F.concat(F.lit(',"checked":'), num(i["checked"]))).otherwise(F.lit("")), more, F.lit("}"))
    children = lambda i: F.when(F.size(i["children"]) > 0, F.concat(F.lit(',"children":'), listed(F.transform(i["children"], lambda c: item(c, F.lit("")))))).otherwise(F.lit(""))
    no_rows = F.array().cast("array<string>")
    own: dict[str, list[Column]] = {
        "heading": [n("level"), t("text")],
        "paragraph": [t("text")],
        "blockquote": [t("text")],
        "horizontalrule": [],
        "table": [
            t("table_id"), t("caption"), n("nested"),
            F.when(C("page_range").isNotNull(), F.concat(F.lit('"page_range":['), C("page_range.start").cast("string"), F.lit(","), C("page_range.end").cast("string"), F.lit("]"))),
            some("continuation_of", "continuation_of"), pair("rows", listed(F.coalesce(F.transform("rows", row), no_rows))),
        ],
        "codeblock": [t("language"), t("code")],
        "mathblock": [t("expression"), n("display_mode")],
        "formfield": [t("field_name"), t("field_type"), t("value")],
        "chart": [t("chart_type"), t("data_ref"), t("x_field"), t("y_field"), F.when(F.size("extra") > 0, pair("extra", F.to_json("extra")))],
        "annotation": [t("annotation_type"), t("text")],
        "keyvaluepair": [t("key"), t("value")],
        "figure": [t("caption"), t("source"), t("figure_id"), some("image_type", "image_type"), some("image_data", "image_data")],
        "footnote": [n("number"), t("text")],
        "listblock": [n("ordered"), n("start"), pair("items", listed(F.coalesce(F.transform("items", lambda i: item(i, children(i))), no_rows)))],
        "crossref": [t("ref_type"), t("ref_id")],
    }
    whole = {k: F.concat(F.lit("{"), F.concat_ws(",", F.lit(f'"type":"{k}"'), *shared, *v), F.lit("}")) for k, v in own.items()}
    whole["pagebreak"] = F.concat(F.lit('{"type":"pagebreak","from_page":'), num(C("from_page")), F.lit(',"to_page":'), num(C("to_page")), F.lit("}"))
    return by_type(whole)


def _json_string(x: Column) -> Column:
    """A JSON string literal: an object of one field, without what is around its value."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def spatial_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, spatial): a document's grid blocks in order as a JSON list; null for a document without any."""
    ints = lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"])
    boxes = lambda a: F.when(F.size(a["cell_bboxes"]) > 0, F.transform(a["cell_bboxes"], ints))
    line = lambda a: F.struct(a["line_text"].alias("text"), F.when(a["bbox"].isNotNull(), ints(a["bbox"])).alias("bbox"), boxes(a).alias("cell_bboxes"))
    block = F.struct("page", F.concat_ws("x", "grid_w", "grid_h").alias("grid"), F.transform("annotations", line).alias("annotations"))
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", F.to_json(block, {"ignoreNullFields": "false"}).alias("s"))))
    return blocks.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda b: b["s"]), ","), F.lit("]")).alias("spatial"))


def to_json(els: DataFrame, front: DataFrame | None = None, spatial: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): the canonical machine form; with ``front`` (doc_id, front json) the frontmatter
    too, and with it the layers: ``spatial`` blocks, and ``metadata`` (doc_id, metadata json)."""
    out = els.select("doc_id", "pos", element_json().alias("s")).groupBy("doc_id").agg(X.joined_in_order(C("s"), C("pos"), ",").alias("e"))
    if front is None:
        return out.select("doc_id", F.concat(F.lit('{"elements":['), C("e"), F.lit("]}")).alias("json"))
    both = front.select("doc_id", "front").join(out, "doc_id", "left")
    version = F.coalesce(F.get_json_object("front", "$.version"), F.lit("1.0"))
    layers = F.lit("")
    for name, layer in (("spatial", None if spatial is None else spatial_json(spatial)), ("metadata", metadata)):
        if layer is not None:
            both = both.join(layer.select("doc_id", name), "doc_id", "left")
            layers = F.concat(layers, F.coalesce(F.concat(F.lit(f',"{name}":'), C(name)), F.lit("")))
    return both.select("doc_id", F.concat(F.lit('{"dox_version":'), _json_string(version), F.lit(',"frontmatter":'), C("front"), F.lit(',"elements":['), F.coalesce("e", F.lit("")), F.lit("]"), layers, F.lit("}")).alias("json"))


# Markdown


def _table_md() -> Column:
    """A table padded to the width of its columns; spans across become empty cells."""
    n = X.num_cols("rows")
    grid = lambda r: F.flatten(F.transform(r["cells"], lambda c: F.concat(F.array(c["text"]), F.array_repeat(F.lit(""), F.greatest(F.lit(0), c["colspan"] - 1)))))
    full = lambda r: F.slice(F.concat(grid(r), F.array_repeat(F.lit(""), n)), F.lit(1), n)

    def drawn(rows: Column) -> Column:
        widths = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(F.get(r["g"], i))))))

        def with_widths(w: Column) -> Column:
            pad = lambda x, i: F.concat(F.lit(" "), x, F.repeat(F.lit(" "), F.get(w, i) - F.length(x)), F.lit(" "))
            line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r["g"], pad), "|"), F.lit("|"))
            rule = F.concat(F.lit("|"), F.array_join(F.transform(w, lambda k: F.repeat(F.lit("-"), k + 2)), "|"), F.lit("|"))
            head, data = F.filter(rows, lambda r: r["h"]), F.filter(rows, lambda r: ~r["h"])
            lines = F.concat(F.transform(head, line), F.when(F.size(head) > 0, F.array(rule)).otherwise(F.array().cast("array<string>")), F.transform(data, line))
            return F.array_join(lines, "\n")

        return F.element_at(F.transform(F.array(widths), with_widths), 1)

    rows = F.transform("rows", lambda r: F.struct(r["is_header"].alias("h"), full(r).alias("g")))
    body = F.element_at(F.transform(F.array(rows), drawn), 1)
    caption = F.when(C("caption") != "", F.concat(F.lit("*"), C("caption"), F.lit("*\n\n"))).otherwise(F.lit(""))
    return F.when((F.coalesce(F.size("rows"), F.lit(0)) == 0) | (n == 0), F.lit("")).otherwise(F.concat(caption, body))


def element_markdown() -> Column:
    fence = F.when(C("code").contains("```"), F.lit("~~~~")).otherwise(F.lit("```"))
    yes = F.lower("value").isin("true", "yes", "1")
    return by_type(
        {
            "heading": _said(F.repeat(F.lit("#"), C("level")), " ", C("text")),
            "paragraph": _said(C("text")),
            "blockquote": _said("> ", F.replace(C("text"), F.lit("\n"), F.lit("\n> "))),
            "horizontalrule": F.lit("---"),
            "table": _table_md(),
            "codeblock": _said(fence, C("language"), "\n", C("code"), "\n", fence),
            "mathblock": _said("$$", C("expression"), "$$"),
            "formfield": F.when(C("field_type") == "checkbox", _said("- [", F.when(yes, "x").otherwise(" "), "] ", C("field_name"))).otherwise(_said("**", C("field_name"), "**: ", C("value"))),
            "chart": _said("*[Chart: ", C("chart_type"), " — data from ", C("data_ref"), "]*"),
            "annotation": _said("*[", C("annotation_type"), ": ", C("text"), "]*"),
            "keyvaluepair": _said("**", C("key"), "**: ", C("value")),
            "figure": _said("![", C("caption"), "](", figure_src(), ")"),
            "footnote": _said("[^", C("number"), "]: ", C("text")),
            "listblock": item_lines("  ", "\n\n"),
            "crossref": _said("[", C("ref_type"), ":", C("ref_id"), "]"),
        }
    )


def to_markdown(els: DataFrame) -> DataFrame:
    """(doc_id, markdown), page breaks left out."""
    parts = els.select("doc_id", "pos", element_markdown().alias("s")).where("s IS NOT NULL")
    return parts.groupBy("doc_id").agg(F.concat(X.joined_in_order(C("s"), C("pos"), "\n\n"), F.lit("\n")).alias("markdown"))


# HTML


def _table_html() -> Column:
    esc = X.html_escape
    span = lambda c: F.concat(*(F.when(c[k] > 1, F.concat(F.lit(f' {k}="'), c[k].cast("string"), F.lit('"'))).otherwise(F.lit("")) for k in ("colspan", "rowspan")))
    line = lambda tag: lambda r: F.concat(F.lit("    <tr>\n"), F.array_join(F.transform(r["cells"], lambda c: F.concat(F.lit(f"      <{tag}"), span(c), F.lit(">"), esc(c["text"]), F.lit(f"</{tag}>\n"))), ""), F.lit("    </tr>\n"))
    head, data = X.header_rows("rows"), X.data_rows("rows")
    return _said(
        "<table", F.when(C("table_id") != "", _said(' id="', esc("table_id"), '"')), ">\n", F.when(C("caption") != "", _said("  <caption>", esc("caption"), "</caption>\n")),
        F.when(F.size(head) > 0, _said("  <thead>\n", F.array_join(F.transform(head, line("th")), ""), "  </thead>\n")),
        "  <tbody>\n", F.array_join(F.transform(data, line("td")), ""), "  </tbody>\n</table>",
    )


def _list_html() -> Column:
    tag = F.when(C("ordered"), F.lit("ol")).otherwise(F.lit("ul"))
    box = lambda x: F.when(x["checked"].isNull(), F.lit("")).otherwise(F.concat(F.lit('<input type="checkbox" '), F.when(x["checked"], F.lit("checked ")).otherwise(F.lit("")), F.lit("disabled> ")))
    inner = lambda x: F.concat(box(x), X.inline_html(x["text"]))
    nested = lambda x: F.when(F.size(x["children"]) > 0, F.concat(F.lit("\n    <"), tag, F.lit(">\n"), F.array_join(F.transform(x["children"], lambda c: F.concat(F.lit("    <li>"), inner(c), F.lit("</li>"))), "\n"), F.lit("\n    </"), tag, F.lit(">\n  "))).otherwise(F.lit(""))
    items = F.array_join(F.transform("items", lambda x: F.concat(F.lit("  <li>"), inner(x), nested(x), F.lit("</li>"))), "\n")
    start = F.when(C("ordered") & (C("start") != 1), _said(' start="', C("start"), '"'))
    return _said("<", tag, start, ">\n", items, "\n</", tag, ">")


def _form_html() -> Column:
    name, value = X.html_escape("field_name"), X.html_escape("value")
    checked = F.when(F.lower("value").isin("true", "yes", "1"), " checked").otherwise("")
    kind = C("field_type")
    return (
        F.when(kind == "checkbox", _said('<label><input type="checkbox" name="', name, '"', checked, " /> ", name, "</label>"))
        .when(kind == "radio", _said('<label><input type="radio" name="', name, '" value="', value, '" /> ', name, "</label>"))
        .when(kind == "select", _said('<select name="', name, '"><option>', value, "</option></select>"))
        .when(kind == "textarea", _said('<textarea name="', name, '">', value, "</textarea>"))
        .otherwise(_said('<input type="text" name="', name, '" value="', value, '" />'))
    )


def element_html() -> Column:
    esc = X.html_escape
    tag = F.concat(F.lit("h"), X.clamp(C("level"), 1, 6).cast("string"))
    kind = F.when(C("display_mode"), "math-block").otherwise("math-inline")
    ref = _said(esc("ref_type"), ":", esc("ref_id"))
    return by_type(
        {
            "heading": _said("<", tag, F.when(C("element_id") != "", _said(' id="', esc("element_id"), '"')), ">", esc("text"), "</", tag, ">"),
            "paragraph": _said("<p>", X.inline_html("text"), "</p>"),
            "blockquote": _said("<blockquote><p>", X.inline_html("text"), "</p></blockquote>"),
            "horizontalrule": F.lit("<hr>"),
            "table": _table_html(),
            "codeblock": _said("<pre><code", F.when(C("language") != "", _said(' class="language-', esc("language"), '"')), ">", esc("code"), "</code></pre>"),
            "mathblock": _said('<span class="', kind, '" data-latex="', esc("expression"), '">$$', esc("expression"), "$$</span>"),
            "formfield": _form_html(),
            "chart": _said('<div class="chart" data-type="', esc("chart_type"), '" data-ref="', esc("data_ref"), '" data-x="', esc("x_field"), '" data-y="', esc("y_field"), '">[Chart: ', esc("chart_type"), "]</div>"),
            "annotation": _said('<mark class="annotation" data-type="', esc("annotation_type"), '">', esc("text"), "</mark>"),
            "keyvaluepair": _said('<div class="kv"><span class="kv-key">', esc("key"), '</span>: <span class="kv-value">', esc("value"), "</span></div>"),
            "figure": _said("<figure", F.when(C("figure_id") != "", _said(' id="', esc("figure_id"), '"')), '><img src="', esc(figure_src()), '" alt="', esc("caption"), '" />', F.when(C("caption") != "", _said("<figcaption>", esc("caption"), "</figcaption>")), "</figure>"),
            "footnote": _said('<aside class="footnote" id="fn-', C("number"), '"><sup>', C("number"), "</sup> ", esc("text"), "</aside>"),
            "listblock": _list_html(),
            "crossref": _said('<a class="ref" href="#', esc("ref_id"), '">', ref, "</a>"),
        }
    )


PAGE_STYLE = "body{max-width:50rem;margin:2rem auto;line-height:1.6}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:.3rem .6rem}"


def to_html(els: DataFrame, standalone: bool = True, lang: str = "en", style: str = PAGE_STYLE) -> DataFrame:
    """(doc_id, html): a fragment, or a whole page titled by the first heading of level 1."""
    parts = els.select("doc_id", "pos", element_html().alias("s"), F.when((C("etype") == "heading") & (C("level") == 1), C("text")).alias("h"))
    title = F.min_by("h", F.when(C("h").isNotNull(), C("pos")))
    body = parts.groupBy("doc_id").agg(X.joined_in_order(C("s"), C("pos"), "\n").alias("body"), title.alias("title"))
    if not standalone:
        return body.select("doc_id", C("body").alias("html"))
    page = _said(f'<!DOCTYPE html>\n<html lang="{lang}">\n<head>\n<meta charset="utf-8" />\n<title>', X.html_escape("title"), f"</title>\n<style>{style}</style>\n</head>\n<body>\n", C("body"), "\n</body>\n</html>")
    return body.select("doc_id", page.alias("html"))


def render_sizes(*renders: tuple[str, DataFrame, str]) -> DataFrame:
    """(doc_id, form, bytes, tokens, lines) of rendered forms, for size comparisons."""
    out = None
    for name, df, column in renders:
        one = df.select("doc_id", F.lit(name).alias("form"), F.octet_length(column).alias("bytes"), X.token_estimate(column).alias("tokens"), (F.regexp_count(column, F.lit("\n")) + 1).alias("lines"))
        out = one if out is None else out.unionByName(one)
    return out
