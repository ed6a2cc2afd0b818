"""Differences between two versions of a corpus, matched by ``doc_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

C = F.col
CHANGE = ["doc_id", "change_type", "element_type", "description", "old_value", "new_value", "element_id", "layer"]


def element_key() -> Column:
    """How elements of two versions are matched: by id, table id, a heading's level and text, or
    type and place."""
    return F.coalesce(
        F.concat(F.lit("id:"), F.when(C("element_id") != "", C("element_id"))),
        F.concat(F.lit("table:"), F.when((C("etype") == "table") & (C("table_id") != ""), C("table_id"))),
        F.when(C("etype") == "heading", F.concat(F.lit("heading:"), C("level").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))),
        F.concat(C("etype"), F.lit(":"), C("index").cast("string")),
    )


def keyed(els: DataFrame) -> DataFrame:
    """One row for each (doc_id, key); of elements with the same key the last holds."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = els.withColumn("index", F.row_number().over(w) - 1).withColumn("match", element_key())
    e = F.struct("pos", "etype", "element_id", "table_id", "level", "text", "code", "language", "caption", "rows")
    return rows.groupBy("doc_id", "match").agg(F.max_by(e, "pos").alias("e"))


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, match, o, n): one full outer join on document and key."""
    a, b = keyed(old).withColumnRenamed("e", "o"), keyed(new).withColumnRenamed("e", "n")
    return a.join(b, ["doc_id", "match"], "full_outer")


def _label(e: Column) -> Column:
    return F.coalesce(F.when(e["element_id"] != "", e["element_id"]), e["table_id"])


def _summary(e: Column) -> Column:
    """What a reader of a change sees of an element: a heading with its marks, the beginning of a
    paragraph, a table's name and size, of others the type."""
    text, etype = F.coalesce(e["text"], F.lit("")), e["etype"]
    table = F.concat(F.lit("Table("), F.coalesce(F.when(e["table_id"] != "", e["table_id"]), F.lit("unnamed")), F.lit(", "), F.coalesce(F.size(e["rows"]), F.lit(0)), F.lit("×"), F.coalesce(X.num_cols(e["rows"]), F.lit(0)), F.lit(")"))
    return (
        F.when(etype == "heading", F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "), text))
        .when(etype == "paragraph", F.concat(F.left(text, F.lit(80)), F.when(F.length(text) > 80, F.lit("...")).otherwise(F.lit(""))))
        .when(etype == "table", table)
        .otherwise(etype)
    )


def _change(kind: str, etype: Column, what: Column, old: Column | None = None, new: Column | None = None, eid: Column | None = None, layer: int = 0) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(F.lit(kind).alias("change_type"), etype.alias("element_type"), what.alias("description"), text(old).alias("old_value"), text(new).alias("new_value"), text(eid).alias("element_id"), F.lit(layer).alias("layer"))


def diff_elements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified elements; headings, paragraphs, tables and code are compared inside."""
    o, n = C("o"), C("n")
    cut = lambda e: F.left(F.coalesce(e["text"], F.lit("")), F.lit(100))
    both = o.isNotNull() & n.isNotNull() & (o["etype"] == n["etype"])
    differs = lambda f: ~o[f].eqNullSafe(n[f])
    size = lambda e: F.coalesce(F.size(e["rows"]), F.lit(0))
    is_ = lambda t: both & (n["etype"] == t)
    rules = [
        (n.isNull(), _change("removed", o["etype"], F.concat(F.lit("removed: "), _summary(o)), _summary(o), None, _label(o))),
        (o.isNull(), _change("added", n["etype"], F.concat(F.lit("added: "), _summary(n)), None, _summary(n), _label(n))),
        (o.isNotNull() & n.isNotNull() & (o["etype"] != n["etype"]), _change("modified", n["etype"], F.lit("type changed"), o["etype"], n["etype"], _label(n))),
        (is_("heading") & differs("text"), _change("modified", n["etype"], F.lit("text changed"), o["text"], n["text"], _label(n))),
        (is_("paragraph") & differs("text"), _change("modified", n["etype"], F.lit("text changed"), cut(o), cut(n), _label(n))),
        (is_("heading") & differs("level"), _change("modified", n["etype"], F.lit("level changed"), o["level"], n["level"], _label(n))),
        (is_("codeblock") & differs("code"), _change("modified", n["etype"], F.lit("code changed"), F.left(o["code"], F.lit(100)), F.left(n["code"], F.lit(100)), _label(n))),
        (is_("codeblock") & differs("language"), _change("modified", n["etype"], F.lit("language changed"), o["language"], n["language"], _label(n))),
        (is_("table") & differs("caption"), _change("modified", n["etype"], F.lit("caption changed"), o["caption"], n["caption"], _label(n))),
        (is_("table") & (size(o) != size(n)), _change("modified", n["etype"], F.lit("row count changed"), size(o), size(n), _label(n))),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), x) for c, x in rules)))
    return matched(old, new).select("doc_id", F.inline(found))


def diff_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed texts of cells that both versions of a table have, by row and cell."""
    pairs = matched(old, new).where("o.etype = 'table' AND n.etype = 'table'")
    cells = lambda e: F.flatten(F.transform(e["rows"], lambda r, i: F.transform(r["cells"], lambda c, j: F.struct(i.alias("r"), j.alias("c"), c["text"].alias("t")))))
    # rows and cells beyond the shorter version are not compared
    a = pairs.select("doc_id", "match", _label(C("n")).alias("eid"), F.inline(cells(C("o")))).withColumnRenamed("t", "old")
    b = pairs.select("doc_id", "match", F.inline(cells(C("n")))).withColumnRenamed("t", "new")
    changed = a.join(b, ["doc_id", "match", "r", "c"]).where("NOT (old <=> new)")
    return changed.select("doc_id", F.inline(F.array(_change("modified", F.lit("table"), F.concat(F.lit("cell ["), C("r").cast("string"), F.lit(","), C("c").cast("string"), F.lit("] changed")), C("old"), C("new"), C("eid")))))


def _map_diff(a: DataFrame, b: DataFrame, etype: str, layer: int, what: str, one_sided: bool = True) -> DataFrame:
    """Differences of key-value rows (doc_id, k, v)."""
    both = a.withColumnRenamed("v", "old").withColumn("in_old", F.lit(True)).join(b.withColumnRenamed("v", "new").withColumn("in_new", F.lit(True)), ["doc_id", "k"], "full_outer")
    changed = both.where(~C("old").eqNullSafe(C("new")))
    kind = F.when(C("in_old").isNull(), "added").when(C("in_new").isNull(), "removed").otherwise("modified") if one_sided else F.lit("modified")
    return changed.select("doc_id", kind.alias("change_type"), F.lit(etype).alias("element_type"), F.concat(F.lit(what), C("k")).alias("description"), C("old").cast("string").alias("old_value"), C("new").cast("string").alias("new_value"), (C("k") if layer == 2 else F.lit(None)).cast("string").alias("element_id"), F.lit(layer).alias("layer"))


def diff_front(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frontmatter fields, from (doc_id, fields map<string,string>)."""
    rows = lambda df: df.select("doc_id", F.explode("fields").alias("k", "v"))
    return _map_diff(rows(old), rows(new), "frontmatter", 0, "")


def diff_confidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Confidences of elements, from (doc_id, confidence map<string,double>)."""
    rows = lambda df: df.select("doc_id", F.explode("confidence").alias("k", "v"))
    return _map_diff(rows(old), rows(new), "confidence", 2, "confidence of ", one_sided=False)


def diff_spatial(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages that only one version has spatial blocks for."""
    pages = lambda df: df.select("doc_id", "page").distinct()
    gone = pages(old).join(pages(new), ["doc_id", "page"], "left_anti").withColumn("change_type", F.lit("removed"))
    come = pages(new).join(pages(old), ["doc_id", "page"], "left_anti").withColumn("change_type", F.lit("added"))
    null = F.lit(None).cast("string")
    return gone.unionByName(come).select("doc_id", "change_type", F.lit("spatial").alias("element_type"), F.concat(F.lit("page "), C("page").cast("string")).alias("description"), null.alias("old_value"), null.alias("new_value"), null.alias("element_id"), F.lit(1).alias("layer"))


def diff_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that the new version's history has beyond the old one's length."""
    n = old.groupBy("doc_id").agg(F.count("*").alias("n"))
    tail = new.join(n, "doc_id", "left").where(C("seq") >= F.coalesce("n", F.lit(0)))
    null = F.lit(None).cast("string")
    return tail.select("doc_id", F.lit("added").alias("change_type"), F.lit("version").alias("element_type"), F.concat_ws(": ", "agent", "action").alias("description"), null.alias("old_value"), C("action").alias("new_value"), null.alias("element_id"), F.lit(2).alias("layer"))


def diff(old, new, ignore_spatial: bool = False, ignore_metadata: bool = False) -> DataFrame:
    """All changes between two parsed corpora, as a bag."""
    fields = lambda c: c.docs.select("doc_id", F.from_json("front", "map<string,string>").alias("fields"))
    out = diff_front(fields(old), fields(new)).unionByName(diff_elements(old.elements, new.elements)).unionByName(diff_cells(old.elements, new.elements))
    if not ignore_spatial:
        out = out.unionByName(diff_spatial(old.spatial_blocks, new.spatial_blocks))
    if not ignore_metadata:
        out = out.unionByName(diff_confidence(old.metadata, new.metadata)).unionByName(diff_history(old.version_history, new.version_history))
    return out.select(*CHANGE)


def of_kind(changes: DataFrame, kind: str) -> DataFrame:
    """The changes of one kind: added, removed or modified."""
    return changes.where(C("change_type") == kind)


def summary(changes: DataFrame) -> DataFrame:
    """(doc_id, added, removed, modified, summary): counts, and what is not zero of them in words.
    Documents without changes have no row."""
    kinds = ("added", "removed", "modified")
    counts = changes.groupBy("doc_id").agg(*(F.count_if(C("change_type") == k).alias(k) for k in kinds))
    return counts.withColumn("summary", F.concat_ws(", ", *(F.when(C(k) > 0, F.concat(C(k).cast("string"), F.lit(f" {k}"))) for k in kinds)))
