"""Corpora of elements made from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.parse import as_elements
from quire.operators.serialize import content

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(*texts):
    one = lambda t, h: F.struct(t.cast("string").alias("text"), F.lit(h).alias("is_header"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    return lambda header: F.struct(F.lit(header).alias("is_header"), F.array(*(one(t, header) for t in texts)).alias("cells"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines): each order with its lineitems, in the one order that is total."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return orders.join(lines, orders.doc_id == lines.l_orderkey, "left").drop("l_orderkey").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))


def orders_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, three key-value pairs, a table with a header and a row for each line, a paragraph
    and a reference to the table; every 7th order refers to a table that isn't there."""
    o = order_lines(spark, sf_dir)
    head = _cells(F.lit("line"), F.lit("part"), F.lit("quantity"))(True)
    row = lambda x: F.struct(
        F.lit(False).alias("is_header"),
        F.array(*(F.struct(v.cast("string").alias("text"), F.lit(False).alias("is_header"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan")) for v in (x["l_linenumber"], x["l_partkey"], x["l_quantity"].cast("long")))).alias("cells"),
    )
    key = C("doc_id").cast("string")
    tid = F.concat(F.lit("t-"), key)
    null = lambda t: F.lit(None).cast(t)
    e = lambda pos, etype, **kw: F.struct(F.lit(pos).alias("pos"), F.lit(etype).alias("etype"), *(kw.get(k, null(t)).cast(t).alias(k) for k, t in FIELDS.items()))
    parts = F.array(
        e(0, "heading", level=F.lit(1), text=F.concat(F.lit("Order "), key)),
        e(1, "keyvaluepair", key=F.lit("customer"), value=C("o_custkey").cast("string")),
        e(2, "keyvaluepair", key=F.lit("status"), value=C("o_orderstatus")),
        e(3, "keyvaluepair", key=F.lit("priority"), value=C("o_orderpriority")),
        e(4, "table", table_id=tid, element_id=tid, nested=F.lit(False), rows=F.concat(F.array(head), F.transform("lines", row))),
        e(5, "paragraph", text=F.concat(F.lit("This order has "), F.size("lines").cast("string"), F.lit(" lines."))),
        e(6, "crossref", ref_type=F.lit("table"), ref_id=F.when(C("doc_id") % 7 == 0, F.concat(F.lit("missing-"), key)).otherwise(tid)),
    )
    return as_elements(o.select("doc_id", F.inline(parts)))


_ROWS = "array<struct<is_header:boolean,cells:array<struct<text:string,is_header:boolean,colspan:int,rowspan:int>>>>"
FIELDS = {"level": "int", "text": "string", "key": "string", "value": "string", "table_id": "string", "element_id": "string", "nested": "boolean", "rows": _ROWS, "ref_type": "string", "ref_id": "string"}


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders corpus rendered to text."""
    return content(orders_corpus(spark, sf_dir))


def lines_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by line: the first a heading, the others paragraphs, and after every fifth a page
    break; confidence is (line % 20) / 20, none for every third line."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    own = lines.select(
        "doc_id", (C("i") * 2).alias("pos"), F.when(C("i") == 0, "heading").otherwise("paragraph").alias("etype"), F.when(C("i") == 0, 2).alias("level"), C("line").alias("text"), "lang",
        F.when(C("i") % 3 != 0, (C("i") % 20) / F.lit(20.0)).alias("confidence"), F.concat(F.lit("l"), C("i").cast("string")).alias("element_id"),
    )
    breaks = lines.where("i % 5 = 4").select("doc_id", (C("i") * 2 + 1).alias("pos"), F.lit("pagebreak").alias("etype"), F.floor((C("i") + 1) / 5).cast("int").alias("from_page"), F.floor((C("i") + 6) / 5).cast("int").alias("to_page"))
    return as_elements(own.unionByName(breaks, allowMissingColumns=True))


def words_corpus(spark: SparkSession, sf_dir: str, size: int = 40) -> DataFrame:
    """Documents cut every 40 words into paragraphs with page breaks between them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "").alias("w"))
    n = F.ceil(F.size("w") / size).cast("int")
    parts = docs.where(F.size("w") > 0).select("doc_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), n.alias("n"))
    own = parts.select("doc_id", (C("k") * 2).alias("pos"), F.lit("paragraph").alias("etype"), F.array_join(F.slice("w", C("k") * size + 1, size), " ").alias("text"))
    breaks = parts.where("k < n - 1").select("doc_id", (C("k") * 2 + 1).alias("pos"), F.lit("pagebreak").alias("etype"), (C("k") + 1).alias("from_page"), (C("k") + 2).alias("to_page"))
    return as_elements(own.unionByName(breaks, allowMissingColumns=True))


def split_tables(spark: SparkSession, sf_dir: str, size: int = 3) -> DataFrame:
    """Orders' lines cut into tables of three rows with page breaks between them: even orders name
    the table that each continues, odd ones leave headerless neighbours."""
    o = order_lines(spark, sf_dir)
    n = F.greatest(F.lit(1), F.ceil(F.size("lines") / size).cast("int"))
    parts = o.select("doc_id", "lines", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    cell = lambda v, h: F.struct(v.cast("string").alias("text"), F.lit(h).alias("is_header"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    row = lambda x: F.struct(F.lit(False).alias("is_header"), F.array(cell(x["l_linenumber"], False), cell(x["l_quantity"].cast("long"), False)).alias("cells"))
    head = F.array(F.struct(F.lit(True).alias("is_header"), F.array(cell(F.lit("line"), True), cell(F.lit("quantity"), True)).alias("cells")))
    rows = F.transform(F.slice("lines", C("k") * size + 1, size), row)
    even = C("doc_id") % 2 == 0
    name = lambda k: F.concat(F.lit("t"), k.cast("string"))
    tables = parts.select(
        "doc_id", (C("k") * 2).alias("pos"), F.lit("table").alias("etype"), (C("k") + 1).alias("page"), F.lit(False).alias("nested"),
        F.when(even | (C("k") == 0), name(C("k"))).alias("table_id"), F.when(even & (C("k") > 0), name(C("k") - 1)).alias("continuation_of"),
        F.when(C("k") == 0, F.concat(head, rows)).otherwise(rows).alias("rows"),
    )
    breaks = parts.where("k < n - 1").select("doc_id", (C("k") * 2 + 1).alias("pos"), F.lit("pagebreak").alias("etype"), (C("k") + 1).alias("from_page"), (C("k") + 2).alias("to_page"))
    return as_elements(tables.unionByName(breaks, allowMissingColumns=True))


def new_version(els: DataFrame) -> DataFrame:
    """The lines corpus one version later: every 11th line gone, every 13th changed."""
    i = C("pos") / 2
    kept = els.where((C("etype") == "pagebreak") | (i % 11 != 10))
    return kept.withColumn("text", F.when((C("etype") == "paragraph") & (i % 13 == 12), F.concat("text", F.lit(" changed"))).otherwise(C("text")))


def conversation_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a heading for each turn of a user, of level 1 at the start, and paragraphs."""
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    head = turns.where("role = 'user' OR k = 0").select(C("conv_id").alias("doc_id"), (C("k") * 2).alias("pos"), F.lit("heading").alias("etype"), F.when(C("k") == 0, 1).otherwise(C("turn") % 4 + 1).cast("int").alias("level"), F.concat(F.lit("turn "), C("turn").cast("string")).alias("text"))
    body = turns.select(C("conv_id").alias("doc_id"), (C("k") * 2 + 1).alias("pos"), F.lit("paragraph").alias("etype"), F.regexp_replace(F.coalesce("text", F.lit("")), "[\n ]+", " ").alias("text"))
    return as_elements(head.unionByName(body, allowMissingColumns=True))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, …, bbox): a spatial line for each part, its box made from the part's size; some
    begin below 0, some lie beyond the grid, some have no area."""
    p = table(spark, sf_dir, "part")
    box = F.struct((C("p_size") * 20 - 40).alias("x1"), (C("p_size") * 10).alias("y1"), (C("p_size") * 25 - 40).alias("x2"), F.when(C("p_partkey") % 9 == 0, C("p_size") * 10).otherwise(C("p_size") * 21).alias("y2"))
    return p.select(
        C("p_partkey").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(1).alias("page"), F.lit(1000).alias("grid_w"), F.lit(1000).alias("grid_h"), F.lit(0).alias("ann_idx"), C("p_name").alias("line_text"),
        box.alias("bbox"), F.lit(None).cast("array<struct<x1:int,y1:int,x2:int,y2:int>>").alias("cell_bboxes"),
    )


def orders_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, html): each order's lines as an HTML table; every second line's last cell spans two columns."""
    o = order_lines(spark, sf_dir)
    line = lambda x: F.concat(F.lit("<tr><td>"), x["l_linenumber"].cast("string"), F.lit("</td><td"), F.when(x["l_linenumber"] % 2 == 0, F.lit(' colspan="2"')).otherwise(F.lit("")), F.lit("><b>"), x["l_quantity"].cast("long").cast("string"), F.lit("</b></td></tr>"))
    return o.select("doc_id", F.concat(F.lit("<table><tr><th>line</th><th>quantity</th></tr>"), F.array_join(F.transform("lines", line), ""), F.lit("</table>")).alias("html"))
