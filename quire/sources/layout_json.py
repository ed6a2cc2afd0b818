"""Pages of a layout benchmark (detections with polygons) to elements and spatial annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.parse import as_elements
from quire.sources.html_table import html_rows

C = F.col

# What each category of the benchmark becomes; others become paragraphs.
CATEGORIES = {
    "title": "heading", "text_block": "paragraph", "table": "table", "equation_isolated": "mathblock", "equation_semantic": "mathblock",
    "figure": "figure", "figure_caption": "paragraph", "table_caption": "paragraph", "table_footnote": "footnote",
    "figure_footnote": "footnote", "page_footnote": "footnote", "header": "paragraph", "footer": "paragraph",
    "page_number": "skip", "abandon": "skip", "text_mask": "skip", "equation_caption": "paragraph", "reference": "paragraph",
    "code_txt": "codeblock", "list_group": "paragraph",
}
SCHEMA = (
    "page_info struct<page_no:int,width:double,height:double,page_attribute:struct<language:string,data_source:string>>,"
    "layout_dets array<struct<category_type:string,order:int,poly:array<double>,text:string,latex:string,html:string,anno_id:string,attribute:map<string,string>>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_info, layout_dets): JSON files, one list of pages each; doc_id is the file."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.input_file_name().alias("doc_id"), "page_info", "layout_dets")


def bbox(poly: Column, width: Column, height: Column, grid: int) -> Column:
    """A polygon's box on the grid, cut to ints and not below 0."""
    even = F.filter(poly, lambda _v, i: i % 2 == 0)
    odd = F.filter(poly, lambda _v, i: i % 2 == 1)
    at = lambda v, size: F.greatest(F.lit(0), (v / size * grid).cast("int"))
    box = F.struct(at(F.array_min(even), width).alias("x1"), at(F.array_min(odd), height).alias("y1"), at(F.array_max(even), width).alias("x2"), at(F.array_max(odd), height).alias("y2"))
    return F.when((F.size(poly) >= 4) & (width > 0) & (height > 0), box)


def detections(pages: DataFrame, grid: int = 1000) -> DataFrame:
    """(doc_id, page, at, …): detections of all pages in reading order, unordered ones last, those
    to skip left out. Pages count from 0 in the source and from 1 here."""
    each = pages.select("doc_id", (C("page_info.page_no") + 1).alias("page"), C("page_info.width").alias("w"), C("page_info.height").alias("h"), F.posexplode("layout_dets").alias("at", "d")).select(
        "doc_id", "page", "w", "h", "at", "d.*"
    )
    names = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    kind = F.coalesce(F.try_element_at(names, C("category_type")), F.lit("paragraph"))
    content = X.stripped(F.coalesce(F.when(kind == "table", C("html")), F.when(kind == "mathblock", C("latex")), C("text"), F.lit("")))
    kept = each.withColumns({"etype": kind, "content": content, "box": bbox(C("poly"), C("w"), C("h"), grid)})
    return kept.where(C("etype") != "skip")


def to_elements(pages: DataFrame, grid: int = 1000) -> DataFrame:
    """Elements of each document: its pages in order, with a page break between them, numbered by
    order. Blank detections are no elements, but for figures."""
    d = detections(pages, grid).where((C("content") != "") | (C("etype") == "figure"))
    level = X.try_int(C("attribute")["level"], None)
    by_length = F.when(F.length("content") < 30, 1).when(F.length("content") < 60, 2).otherwise(3)
    latex = F.regexp_replace(C("content"), r"^\$\$?|\$\$?$", "")
    own = d.select(
        "doc_id", "page", F.coalesce("order", F.lit(999)).alias("o"), "at", "etype", C("anno_id").alias("element_id"), C("order").alias("reading_order"), C("box").alias("bbox"),
        F.when(C("etype") == "heading", F.coalesce(X.clamp(level, 1, 6), by_length)).alias("level"),
        F.when(C("etype").isin("heading", "paragraph", "footnote"), C("content")).alias("text"),
        F.when(C("etype") == "codeblock", C("content")).alias("code"),
        F.when(C("etype") == "mathblock", X.stripped(latex)).alias("expression"), F.when(C("etype") == "mathblock", C("category_type") == "equation_isolated").alias("display_mode"),
        F.when(C("etype") == "table", html_rows(C("html"))).alias("rows"), F.when(C("etype") == "table", C("anno_id")).alias("table_id"), F.when(C("etype") == "table", False).alias("nested"),
        F.when(C("etype") == "figure", C("content")).alias("caption"), F.when(C("etype") == "figure", F.lit("")).alias("source"),
        F.when(C("etype") == "footnote", F.row_number().over(Window.partitionBy("doc_id", "etype").orderBy("page", "at"))).alias("number"),
        C("category_type").isin("header", "footer").alias("is_furniture"),
    )
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    steps = pages.select("doc_id", (C("page_info.page_no") + 1).alias("page")).distinct().withColumn("nth", nth).where("nth > 1")
    breaks = steps.select("doc_id", "page", F.lit(-1).alias("o"), F.lit(-1).alias("at"), F.lit("pagebreak").alias("etype"), (C("nth") - 1).alias("from_page"), C("nth").alias("to_page"))
    both = own.unionByName(breaks, allowMissingColumns=True)
    placed = both.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "o", "at")) - 1)
    return as_elements(placed.withColumn("page", F.when(C("etype") != "pagebreak", C("page"))))


def to_spatial(pages: DataFrame, grid: int = 1000) -> DataFrame:
    """(doc_id, block_idx, page, grid_w, grid_h, annotations): one block for each page, blank detections included."""
    a = F.struct(F.left("content", F.lit(80)).alias("line_text"), C("box").alias("bbox"), F.lit(None).cast("array<struct<x1:int,y1:int,x2:int,y2:int>>").alias("cell_bboxes"))
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("order", F.lit(999)).alias("o"), "at", a.alias("a"))))
    blocks = detections(pages, grid).where("box IS NOT NULL").groupBy("doc_id", "page").agg(F.transform(rows, lambda r: r["a"]).alias("annotations"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return blocks.select("doc_id", idx.alias("block_idx"), "page", F.lit(grid).alias("grid_w"), F.lit(grid).alias("grid_h"), "annotations")


def language(pages: DataFrame) -> DataFrame:
    """(doc_id, lang): two letters of the first language named on a document's first three pages."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_info.page_no"))
    named = pages.withColumn("k", nth).where((C("k") <= 3) & (C("page_info.page_attribute.language") != ""))
    return named.groupBy("doc_id").agg(F.left(F.min_by("page_info.page_attribute.language", "k"), F.lit(2)).alias("lang"))


def fonts(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_size, mean_size): a document's font sizes, the upper median being its body's.
    Sizes are counted before they move, so documents of any length gather one row for each size."""
    counts = blocks.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("size")
    upto = counts.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy("doc_id"))})
    return upto.groupBy("doc_id").agg(F.min(F.when(C("upto") > F.floor(C("all") / 2), C("size"))).alias("body_size"), (F.sum(C("size") * C("n")) / F.max("all")).alias("mean_size"))


def heading_level(size: Column, body: Column, bold: Column, text: Column) -> Column:
    """The level of a line that looks like a heading by its font, else null."""
    ratio, n = size / body, F.length(text)
    looks = (n <= 200) & ((ratio > 1.3) | (bold & (ratio >= 1) & (n < 80)))
    return F.when(looks, F.when(ratio > 1.8, 1).when(ratio > 1.4, 2).when(ratio > 1.2, 3).otherwise(4))


def looks_like_math(text: Column) -> Column:
    """Whether a line holds LaTeX commands."""
    # fixed values: the commands that count
    return text.rlike(r"\\(frac|sum|int|sqrt|alpha|beta|begin\{|end\{|left|right)")
