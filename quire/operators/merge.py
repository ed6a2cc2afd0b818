"""Reassembly across pages: page numbers, split tables, split paragraphs, page breaks."""

from __future__ import annotations

import difflib
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.operators.access import in_order

C = F.col


@dataclass(frozen=True)
class MergeConfig:
    assign_pages: bool = True
    merge_tables: bool = True
    merge_paragraphs: bool = True
    remove_page_breaks: bool = False
    similarity: float = 0.5


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two strings; only asked where equality and length leave it open."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def assign_pages(els: DataFrame) -> DataFrame:
    """Fills in missing pages in documents with page breaks: 1, then what the last break leads to.
    Pages that are set stay, and breaks get none."""
    before = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has_breaks = F.max(C("etype") == "pagebreak").over(Window.partitionBy("doc_id"))
    reached = F.coalesce(F.last(F.when(C("etype") == "pagebreak", C("to_page")), ignorenulls=True).over(before), F.lit(1))
    return els.withColumn("page", F.when(has_breaks & C("page").isNull() & (C("etype") != "pagebreak"), reached).otherwise(C("page")))


def pages_from_spatial(els: DataFrame, annotations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fills in missing pages by the most similar annotated line of the same document, above a
    threshold; the first of equals. For documents without page breaks. Pairs are made within a
    document only, and equal texts need no comparison."""
    text = F.left(F.coalesce("text", "code", "caption", "key", F.lit("")), F.lit(100))
    broken = els.where("etype = 'pagebreak'").select("doc_id").distinct()
    open_ = els.where("page IS NULL").join(broken, "doc_id", "left_anti").select("doc_id", "pos", text.alias("mine")).where("mine <> ''")
    lines = annotations.select("doc_id", "block_idx", "ann_idx", C("page").alias("line_page"), F.left("line_text", F.lit(100)).alias("line")).where("line <> ''")
    exact = open_.join(lines.withColumn("mine", C("line")), ["doc_id", "mine"]).select("doc_id", "pos", F.lit(1.0).alias("s"), "block_idx", "ann_idx", "line_page")
    left = open_.join(exact.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti")
    # a ratio above t needs lengths within a factor of (2 - t) / t
    near = left.join(lines, "doc_id").where((2 - threshold) * F.least(F.length("mine"), F.length("line")) > threshold * F.greatest(F.length("mine"), F.length("line")))
    close = near.withColumn("s", similarity("mine", "line")).where(C("s") > threshold).select("doc_id", "pos", "s", "block_idx", "ann_idx", "line_page")
    best = exact.unionByName(close).groupBy("doc_id", "pos").agg(F.max_by("line_page", F.struct("s", -C("block_idx"), -C("ann_idx"))).alias("found"))
    return els.join(best, ["doc_id", "pos"], "left").withColumn("page", F.coalesce("page", "found")).drop("found")


def table_roots(els: DataFrame) -> DataFrame:
    """(doc_id, pos, root, named): for each table the table that it continues, through any number of
    steps, and whether it names what it continues.

    A table continues the one that its continuation_of names (the last table of that id), or,
    without header rows and without that, the table before it across one page break, if
    both are equally wide. Tables that continue each other in a circle continue the first of them.
    """
    w = in_order()
    row = F.struct("etype", "pos", X.num_cols("rows").alias("cols"))
    seen = els.select("doc_id", "pos", "etype", "table_id", "continuation_of", "rows", F.lag("etype").over(w).alias("mid"), F.lag(row, 2).over(w).alias("back"))
    tables = seen.where("etype = 'table'")
    named = tables.where("table_id IS NOT NULL").groupBy("doc_id", C("table_id").alias("name")).agg(F.max("pos").alias("named_pos"))
    headless = F.size(X.header_rows("rows")) == 0
    beside = F.when((C("mid") == "pagebreak") & (C("back.etype") == "table") & headless & C("continuation_of").isNull() & (C("back.cols") == X.num_cols("rows")), C("back.pos"))
    mine = tables.withColumn("beside", beside).select("doc_id", "pos", "continuation_of", "beside")
    other = named.select(C("doc_id").alias("named_doc"), "name", "named_pos")
    links = mine.join(other, (C("doc_id") == C("named_doc")) & (C("continuation_of") == C("name")) & (C("pos") != C("named_pos")), "left").select(
        "doc_id", "pos", F.coalesce("named_pos", "beside").alias("up"), C("named_pos").isNotNull().alias("named")
    )
    # a document's links are followed within one row, by places in an array: each round doubles
    # the steps and takes the least place on the way, which in a circle ends with its first table
    rows = links.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "up", "named"))).alias("l")).withColumn("places", C("l.pos"))
    at = F.transform("l", lambda x, i: F.when(x["up"].isNull(), i + 1).otherwise(F.array_position("places", x["up"]).cast("int")))
    start = F.struct(at.alias("up"), F.transform("l", lambda _x, i: i + 1).alias("low"))
    lower = lambda acc: F.transform(acc["low"], lambda x, i: F.least(x, F.get(acc["low"], F.get(acc["up"], i) - 1)))
    double = lambda acc, _i: F.struct(F.transform(acc["up"], lambda x: F.get(acc["up"], x - 1)).alias("up"), lower(acc).alias("low"))
    rounds = F.ceil(F.log2(F.size("l").cast("double"))).cast("int") + 1
    ends = rows.withColumn("end", F.aggregate(F.sequence(F.lit(1), rounds), start, double))
    root = lambda i: F.get("places", F.get(C("end.low"), F.get(C("end.up"), i) - 1) - 1)
    return ends.select("doc_id", F.inline(F.transform("l", lambda x, i: F.struct(x["pos"].alias("pos"), root(i).alias("root"), x["named"].alias("named")))))


def merge_tables(els: DataFrame) -> DataFrame:
    """Continued tables joined to their first part: data rows appended in order, page range widened.

    A named part on a known page widens the range, from page 1 if the first part's is not
    known; a part beside the first only if both pages are known.
    """
    roots = table_roots(els)
    tables = els.where("etype = 'table'").join(roots, ["doc_id", "pos"])
    parts = F.array_sort(F.collect_list(F.struct((C("pos") != C("root")).alias("later"), "pos", "rows", "page", "page_range", "named")))
    merged = tables.groupBy("doc_id", "root").agg(parts.alias("parts"), F.count("*").alias("k"))
    first = F.get("parts", F.lit(0))
    later = F.slice("parts", 2, F.size("parts"))
    more = F.flatten(F.transform(later, lambda p: F.coalesce(p["rows"], F.array().cast(els.schema["rows"].dataType))))
    known = F.filter(later, lambda p: p["page"].isNotNull() & (p["named"] | first["page"].isNotNull()))
    ends = F.greatest(first["page_range"]["end"], F.array_max(F.transform(known, lambda p: p["page"])))
    start = F.coalesce(first["page_range"]["start"], first["page"], F.lit(1))
    joined = merged.where("k > 1").select(
        "doc_id", C("root").alias("pos"), F.concat(F.coalesce(first["rows"], F.array().cast(els.schema["rows"].dataType)), more).alias("all_rows"),
        F.when(F.size(known) > 0, F.struct(start.alias("start"), ends.alias("end"))).alias("wide"),
    )
    gone = roots.where("pos <> root").select("doc_id", "pos")
    kept = els.join(gone, ["doc_id", "pos"], "left_anti").join(joined, ["doc_id", "pos"], "left")
    return kept.withColumn("rows", F.coalesce("all_rows", "rows")).withColumn("page_range", F.coalesce("wide", "page_range")).drop("all_rows", "wide").select(*els.columns)


def merge_paragraphs(els: DataFrame, alike: float = 0.9) -> DataFrame:
    """Paragraphs cut by a page break, as one. Pairs are taken from the front and don't overlap:
    of three in a row, the first two join."""
    w = in_order()
    split = els.withColumns({"_e1": F.lead("etype", 1).over(w), "_e2": F.lead("etype", 2).over(w), "_t2": F.lead("text", 2).over(w), "_p2": F.lead("pos", 2).over(w)})
    a, b = X.stripped("text"), X.stripped("_t2")
    shape = (C("etype") == "paragraph") & (C("_e1") == "pagebreak") & (C("_e2") == "paragraph")
    could = F.coalesce(shape & (a != "") & (b != "") & ~a.rlike("[.!?:]$"), F.lit(False))
    long = could & (F.length(a) > 20) & (F.length(b) > 20)
    edge = lambda x, side: side(x, F.least(F.lit(30), F.length(x)))
    # alike at the boundary means the same text twice, not a sentence cut in two
    # a ratio above ``alike`` leaves few of at most 60 characters unmatched, so few edits apart
    close = long & (F.levenshtein(edge(a, F.right), edge(b, F.left), math.ceil((1 - alike) * 60)) >= 0)
    rows = split.withColumns({"_could": could, "_long": close, "_a": F.when(close, edge(a, F.right)), "_b": F.when(close, edge(b, F.left))})
    ok = rows.withColumn("_fit", F.when(C("_long"), similarity("_a", "_b") <= alike).otherwise(C("_could"))).drop("_could", "_long", "_a", "_b")
    # eligible pairs in a row start two positions apart; keep every other one of each run
    step = ok.withColumn("_prev", F.lag("_fit", 2, False).over(w))
    run = F.sum(F.when(C("_fit") & ~C("_prev"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "_par").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lanes = step.withColumn("_par", F.row_number().over(w) % 2).withColumn("_run", run)
    nth = F.sum(C("_fit").cast("int")).over(Window.partitionBy("doc_id", "_par", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    chosen = lanes.withColumn("_take", C("_fit") & (nth % 2 == 1))
    eaten = chosen.withColumn("_gone", F.lag("_take", 2, False).over(w))
    text = F.when(C("_take"), X.overlap_join(a, b)).otherwise(C("text"))
    return eaten.where(~C("_gone")).withColumn("text", text).select(*els.columns)


def merge(els: DataFrame, config: MergeConfig | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """All passes in order; positions keep their values, with gaps where elements went."""
    c = config or MergeConfig()
    if c.assign_pages:
        els = assign_pages(els)
        if annotations is not None:
            els = pages_from_spatial(els, annotations, c.similarity)
    if c.merge_tables:
        els = merge_tables(els)
    if c.merge_paragraphs:
        els = merge_paragraphs(els)
    return els.where("etype <> 'pagebreak'") if c.remove_page_breaks else els


def merge_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, tables_merged, paragraphs_merged, pages_assigned, page_breaks_removed)."""
    is_ = lambda t: F.count_if(C("etype") == t)
    count = lambda df, x: df.groupBy("doc_id").agg(is_("table").alias(f"t{x}"), is_("paragraph").alias(f"p{x}"), F.count_if(C("page").isNotNull()).alias(f"n{x}"), is_("pagebreak").alias(f"b{x}"))
    paged = before.where("page IS NULL").select("doc_id", "pos").join(after.where("page IS NOT NULL").select("doc_id", "pos"), ["doc_id", "pos"]).groupBy("doc_id").agg(F.count("*").alias("assigned"))
    both = count(before, 0).join(count(after, 1), "doc_id").join(paged, "doc_id", "left")
    return both.select("doc_id", (C("t0") - C("t1")).alias("tables_merged"), (C("p0") - C("p1")).alias("paragraphs_merged"), F.coalesce("assigned", F.lit(0)).alias("pages_assigned"), (C("b0") - C("b1")).alias("page_breaks_removed"))
