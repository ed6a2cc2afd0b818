"""Validation rules, each a projection to the issues schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

C = F.col
SCHEMA = "rule string, severity string, message string, element_id string, layer int"


def _issue(rule: str, severity: str, message: Column, layer: int, element_id: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"),
        (element_id if element_id is not None else F.lit(None)).cast("string").alias("element_id"), F.lit(layer).alias("layer"),
    )


def _issues(df: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """One pass over ``df``: (doc_id, issue columns) of all rules that hold for a row."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), issue) for cond, issue in rules)))
    return df.select("doc_id", F.inline(found))


def _msg(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def front_issues(front: DataFrame) -> DataFrame:
    v = C("version")
    return _issues(
        front,
        (v.isNull() | (v == ""), _issue("version_missing", "error", _msg("no version"), 0)),
        ((v != "") & ~v.isin("1.0", "0.1"), _issue("version_unknown", "warning", _msg("unknown version ", v), 0)),
        (C("pages") < 1, _issue("pages_below_one", "error", _msg("pages is ", C("pages")), 0)),
    )


def identity(els: DataFrame) -> Column:
    return F.coalesce(F.when(C("element_id") != "", C("element_id")), F.when((C("etype") == "table") & (C("table_id") != ""), C("table_id")))


def duplicate_ids(els: DataFrame) -> DataFrame:
    """Every occurrence of an id after its first in a document."""
    named = els.withColumn("eid", identity(els)).where("eid IS NOT NULL")
    nth = named.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "eid").orderBy("pos")))
    return _issues(nth, (C("k") > 1, _issue("duplicate_id", "error", _msg("id used again: ", C("eid")), 0, C("eid"))))


def element_issues(els: DataFrame) -> DataFrame:
    """Rules that need nothing but the element."""
    empty = F.coalesce(F.size("rows"), F.lit(0)) == 0
    meta = F.coalesce(*(C(c).cast("string") for c in ("element_id", "page", "confidence", "reading_order", "lang"))).isNotNull() | C("is_furniture") | C("bbox").isNotNull()
    is_ = lambda t: C("etype") == t
    return _issues(
        els,
        (is_("heading") & ~C("level").between(1, 6), _issue("heading_level", "error", _msg("heading level ", C("level")), 0, C("element_id"))),
        (is_("heading") & (X.stripped(F.coalesce("text", F.lit(""))) == ""), _issue("heading_blank", "warning", _msg("blank heading"), 0, C("element_id"))),
        (is_("table") & empty, _issue("table_empty", "warning", _msg("table without rows"), 0, C("table_id"))),
        (is_("formfield") & (F.coalesce("field_name", F.lit("")) == ""), _issue("field_unnamed", "warning", _msg("form field without a name"), 0, C("element_id"))),
        (is_("pagebreak") & ((C("from_page") < 1) | (C("to_page") < 1)), _issue("break_below_one", "error", _msg("page break to a page below 1"), 0)),
        (is_("pagebreak") & (C("from_page") >= 1) & (C("to_page") >= 1) & (C("to_page") <= C("from_page")), _issue("break_backwards", "error", _msg("page break from ", C("from_page"), " to ", C("to_page")), 0)),
        (is_("pagebreak") & meta, _issue("break_metadata", "warning", _msg("page break with element metadata"), 0)),
    )


def row_widths(els: DataFrame) -> DataFrame:
    """Rows of another width than their table, spans counted: those across in the row itself, and
    those down in the rows that they reach."""
    tables = els.where("etype = 'table'").select("doc_id", "pos", "table_id", X.num_cols("rows").alias("cols"), F.posexplode("rows").alias("row_idx", "r"), "rows")
    cells = lambda r: F.aggregate(r["cells"], F.lit(0), lambda a, c: a + F.greatest(F.lit(1), c["colspan"]))
    reaching = lambda row, i: F.aggregate(row["cells"], F.lit(0), lambda a, c: a + F.when(i + c["rowspan"] > C("row_idx"), F.greatest(F.lit(1), c["colspan"])).otherwise(0))
    above = F.aggregate(F.transform(F.slice("rows", F.lit(1), C("row_idx")), reaching), F.lit(0), lambda a, x: a + x)
    wide = tables.withColumn("width", cells(C("r")) + above)
    return _issues(wide, (C("width") != C("cols"), _issue("row_width", "warning", _msg("row ", C("row_idx"), " has ", C("width"), " of ", C("cols"), " columns"), 0, C("table_id"))))


def targets(els: DataFrame) -> DataFrame:
    """(doc_id, target): what references may name: element ids and table ids, not figure ids."""
    own = els.select("doc_id", C("element_id").alias("target")).unionByName(els.where("etype = 'table'").select("doc_id", C("table_id").alias("target")))
    return own.where("target <> ''").distinct()


def unresolved(els: DataFrame) -> DataFrame:
    """Cross-references and charts' data references that name nothing in their document, in one pass over its elements."""
    said = lambda when, target, kind: F.when(when, F.struct(target.alias("target"), F.lit(kind).alias("kind")))
    each = F.array(
        said(C("element_id") != "", C("element_id"), ""), said((C("etype") == "table") & (C("table_id") != ""), C("table_id"), ""),
        said(C("etype") == "crossref", C("ref_id"), "ref_unresolved"), said((C("etype") == "chart") & (C("data_ref") != ""), C("data_ref"), "chart_unresolved"),
    )
    names = els.select("doc_id", "element_id", F.inline(F.filter(each, lambda x: x.isNotNull())))
    known = F.max(C("kind") == "").over(Window.partitionBy("doc_id", "target"))
    lost = names.withColumn("known", known & C("target").isNotNull()).where("NOT known AND kind <> ''")
    return lost.select("doc_id", C("kind").alias("rule"), F.lit("warning").alias("severity"), _msg("nothing is named ", C("target")).alias("message"), "element_id", F.lit(0).alias("layer"))


def bbox_issues(annotations: DataFrame) -> DataFrame:
    """Rules for boxes of lines and cells, against their block's grid."""
    boxes = F.array_compact(F.concat(F.array("bbox"), F.coalesce("cell_bboxes", F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))))
    each = annotations.select("doc_id", "grid_w", "grid_h", F.explode(boxes).alias("b"))
    return _issues(
        each,
        ((C("b.x1") < 0) | (C("b.y1") < 0), _issue("bbox_negative", "error", _msg("box begins below 0"), 1)),
        ((C("b.x2") > C("grid_w")) | (C("b.y2") > C("grid_h")), _issue("bbox_outside", "warning", _msg("box beyond the grid"), 1)),
        ((C("b.x2") <= C("b.x1")) | (C("b.y2") <= C("b.y1")), _issue("bbox_area", "error", _msg("box without area"), 1)),
    )


def spatial_page_issues(blocks: DataFrame) -> DataFrame:
    return _issues(blocks, (C("page") < 1, _issue("spatial_page", "error", _msg("spatial page ", C("page")), 1)))


def confidence_issues(metadata: DataFrame, threshold: float = 0.90) -> DataFrame:
    low = min(1.0, max(0.0, threshold))
    own = _issues(
        metadata,
        (~C("overall").between(0, 1), _issue("overall_range", "error", _msg("overall confidence ", C("overall")), 2)),
        (F.coalesce("source_hash", F.lit("")) == "", _issue("no_source_hash", "warning", _msg("no source hash"), 2)),
    )
    each = _issues(
        metadata.select("doc_id", F.explode("confidence").alias("k", "v")),
        (~C("v").between(0, 1), _issue("confidence_range", "error", _msg("confidence ", C("v")), 2, C("k"))),
        (C("v").between(0, 1) & (C("v") < low), _issue("confidence_low", "info", _msg("confidence ", C("v")), 2, C("k"))),
    )
    return own.unionByName(each)


def note_issues(parsed_docs: DataFrame) -> DataFrame:
    """Layers that could not be read."""
    return parsed_docs.select("doc_id", F.explode("notes").alias("n")).select("doc_id", F.lit("layer_unreadable").alias("rule"), F.lit("error").alias("severity"), C("n").alias("message"), F.lit(None).cast("string").alias("element_id"), F.lit(0).alias("layer"))


def validate_elements(els: DataFrame) -> DataFrame:
    """All rules of layer 0 that elements decide."""
    return element_issues(els).unionByName(duplicate_ids(els)).unionByName(row_widths(els)).unionByName(unresolved(els))


def validate(corpus, threshold: float = 0.90) -> DataFrame:
    """(doc_id, rule, severity, message, element_id, layer) of a parsed corpus, all rules."""
    out = front_issues(corpus.front).unionByName(validate_elements(corpus.elements))
    for part in (spatial_page_issues(corpus.spatial_blocks), bbox_issues(corpus.spatial_annotations), confidence_issues(corpus.metadata, threshold), note_issues(corpus.docs)):
        out = out.unionByName(part)
    return out


def summary(issues: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, infos, is_valid)."""
    n = lambda s: F.count_if(C("severity") == s)
    return issues.groupBy("doc_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), (~F.bool_or(C("severity") == "error")).alias("is_valid"))
