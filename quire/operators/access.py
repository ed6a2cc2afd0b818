"""Accessors and statistics over elements: filters, lookups and counts, all plain relational."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

C = F.col


def of_type(els: DataFrame, etype: str) -> DataFrame:
    return els.where(C("etype") == etype)


def headings(els: DataFrame) -> DataFrame:
    return of_type(els, "heading")


def tables(els: DataFrame) -> DataFrame:
    return of_type(els, "table")


def paragraphs(els: DataFrame) -> DataFrame:
    return of_type(els, "paragraph")


def key_values(els: DataFrame) -> DataFrame:
    return of_type(els, "keyvaluepair").select("doc_id", "pos", "key", "value")


def furniture(els: DataFrame) -> DataFrame:
    return els.where(F.coalesce("is_furniture", F.lit(False)))


def body(els: DataFrame) -> DataFrame:
    return els.where(~F.coalesce("is_furniture", F.lit(False)))


def by_id(els: DataFrame, element_id: str) -> DataFrame:
    """The first element of each document with this id, or table with this table id."""
    named = els.where((C("element_id") == element_id) | ((C("etype") == "table") & (C("table_id") == element_id)))
    return named.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in els.columns if c != "doc_id"]), "pos").alias("e")).select("doc_id", "e.*")


def flagged(els: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Elements below a confidence; those without one are not."""
    return els.where(C("confidence") < threshold)


def flagged_entries(metadata: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, key, confidence): entries of the confidence map below a threshold."""
    return metadata.select("doc_id", F.explode(F.map_filter("confidence", lambda _k, v: v < threshold)).alias("key", "confidence"))


def toc(els: DataFrame) -> DataFrame:
    return headings(els).select("doc_id", "pos", "level", "text", "element_id")


def layer0_text(els: DataFrame) -> DataFrame:
    """(doc_id, text): headings and paragraphs, in order."""
    rows = els.where(C("etype").isin("heading", "paragraph"))
    return rows.groupBy("doc_id").agg(X.joined_in_order(C("text"), C("pos"), "\n\n").alias("text"))


def title(els: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading of level 1."""
    return headings(els).where("level = 1").groupBy("doc_id").agg(F.min_by("text", "pos").alias("title"))


def statistics(els: DataFrame) -> DataFrame:
    """(doc_id, etype, n)."""
    return els.groupBy("doc_id", "etype").agg(F.count("*").alias("n"))


def table_shapes(els: DataFrame) -> DataFrame:
    """(doc_id, pos, table_id, num_rows, num_cols): columns count spans across, not down."""
    return tables(els).select("doc_id", "pos", "table_id", F.coalesce(F.size("rows"), F.lit(0)).alias("num_rows"), X.num_cols("rows").alias("num_cols"))


def without_breaks(els: DataFrame) -> DataFrame:
    return els.where("etype <> 'pagebreak'")


def in_order(*more: str) -> Window:
    """A document's elements in order; the partitioning that all sequential operators share."""
    return Window.partitionBy("doc_id", *more).orderBy("pos")


def heading_levels(els: DataFrame, deepest: int = 6) -> DataFrame:
    """``els`` with ``path``: the headings that an element stands under, itself included if it is one.

    The last heading of each level holds unless a shallower one came after it; a skipped level
    has an empty name.
    """
    so_far = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_heading = (C("etype") == "heading") & (C("level") <= deepest)
    last = {k: F.last(F.when(is_heading & (C("level") == k), F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))), ignorenulls=True).over(so_far) for k in range(1, 7)}
    out = els.withColumns({f"_h{k}": v for k, v in last.items()})
    live = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(C(f"_h{j}.pos"), F.lit(-1)) for j in range(1, k)))
        live.append(F.when(C(f"_h{k}.pos") > above, C(f"_h{k}.text")))
    depth = F.greatest(F.lit(0), *(F.when(v.isNotNull(), F.lit(k)).otherwise(0) for k, v in enumerate(live, 1)))
    path = F.slice(F.transform(F.array(*live), lambda x: F.coalesce(x, F.lit(""))), F.lit(1), depth)
    return out.withColumn("path", path).drop(*(f"_h{k}" for k in range(1, 7)))
