"""The engine's registered queries and the SQL that gives the same rows.

Each query makes a corpus from the driver's tables (``adapters``), runs an operator on it, and
returns rows that SQL can compute from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import access, chunk, diff, export, merge, validate
from quire.operators import parse as P
from quire.operators import serialize as S
from quire.plans import adapters as A
from quire.sources.html_table import html_rows

C = F.col
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Pieces of SQL that several oracles share.
_LINES = """l AS (
  SELECT doc_id, lang, i, line, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
)"""
_WORDS = r"len(regexp_extract_all({0}, '\S+'))"
_TURNS = """t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
e AS (
  SELECT conv_id AS doc_id, k * 2 AS pos, CASE WHEN k = 0 THEN 1 ELSE turn % 4 + 1 END AS level, turn FROM t WHERE role = 'user' OR k = 0
  UNION ALL SELECT conv_id, k * 2 + 1, NULL, turn FROM t
)"""
_SIZES = "s AS (SELECT o_orderkey AS doc_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"


def query(sql: str | None):
    """Registers a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def parsed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elements(P.parse(A.orders_text(spark, sf_dir)))


@query("""SELECT etype, CAST(m * (SELECT count(*) FROM orders) AS BIGINT) AS n
FROM (VALUES ('heading', 1), ('keyvaluepair', 3), ('table', 1), ('paragraph', 1), ('crossref', 1)) AS v(etype, m)""")
def element_statistics(spark, sf_dir):
    return access.statistics(parsed_orders(spark, sf_dir)).groupBy("etype").agg(F.sum("n").alias("n"))


@query(f"WITH {_SIZES} SELECT doc_id, 't-' || doc_id AS table_id, CAST(n + 1 AS INT) AS num_rows, 3 AS num_cols FROM s")
def parse_order_tables(spark, sf_dir):
    return access.table_shapes(parsed_orders(spark, sf_dir)).select("doc_id", "table_id", "num_rows", "num_cols")


@query("SELECT l_orderkey AS doc_id, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def parse_cells_sum(spark, sf_dir):
    cells = P.table_cells(parsed_orders(spark, sf_dir)).where("NOT is_header AND cell_idx = 2")
    return cells.groupBy("doc_id").agg(F.sum(X.try_int("text")).alias("quantity"))


@query("""SELECT o_orderkey AS doc_id, 'customer' AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""")
def roundtrip_kv(spark, sf_dir):
    return access.key_values(parsed_orders(spark, sf_dir)).select("doc_id", "key", "value")


@query("SELECT o_orderkey AS doc_id, true AS same FROM orders")
def text_roundtrip(spark, sf_dir):
    first = A.orders_text(spark, sf_dir)
    again = S.content(P.elements(P.parse(first))).withColumnRenamed("text", "again")
    return first.join(again, "doc_id").select("doc_id", (C("text") == C("again")).alias("same"))


@query("SELECT o_orderkey AS doc_id, 1 AS level, 'Order ' || o_orderkey AS text FROM orders")
def toc(spark, sf_dir):
    return access.toc(parsed_orders(spark, sf_dir)).select("doc_id", "level", "text")


@query("SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title FROM orders")
def title(spark, sf_dir):
    return access.title(A.orders_corpus(spark, sf_dir))


@query(f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS n FROM documents) SELECT doc_id, CAST((13 * n) // 10 AS INT) AS tokens FROM w")
def token_estimate(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(i * 2 AS INT) AS pos, CAST(CASE WHEN n >= 5 THEN i // 5 + 1 END AS INT) AS page FROM l")
def assign_pages(spark, sf_dir):
    return merge.assign_pages(A.lines_corpus(spark, sf_dir)).where("etype <> 'pagebreak'").select("doc_id", "pos", "page")


@query(f"""WITH {_LINES} SELECT doc_id, CAST(i // 5 + 1 AS INT) AS page, CAST(count(*) AS INT) AS element_count,
trim(string_agg(CASE WHEN i = 0 THEN '## ' ELSE '' END || line, chr(10) || chr(10) ORDER BY i)) AS text FROM l GROUP BY doc_id, i // 5""")
def page_chunks(spark, sf_dir):
    els = access.without_breaks(merge.assign_pages(A.lines_corpus(spark, sf_dir)))
    return chunk.by_page(els).select("doc_id", "page", "element_count", "text")


@query(f"""WITH {_TURNS}, g AS (SELECT doc_id, sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM e)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS chunk, CAST(count(*) AS INT) AS element_count FROM g GROUP BY doc_id, grp""")
def heading_chunks(spark, sf_dir):
    return chunk.by_heading(A.conversation_corpus(spark, sf_dir)).select("doc_id", "chunk", "element_count")


@query(f"""WITH {_LINES} SELECT doc_id, CAST(i AS INT) AS chunk,
CAST((13 * ({_WORDS.format('line')} + CASE WHEN i = 0 THEN 1 ELSE 0 END)) // 10 AS INT) AS token_estimate FROM l""")
def element_chunks(spark, sf_dir):
    return chunk.by_element(access.without_breaks(A.lines_corpus(spark, sf_dir))).select("doc_id", "chunk", "token_estimate")


@query(f"""WITH RECURSIVE {_LINES}, w AS (
  SELECT doc_id, i, n, {_WORDS.format('line')} + CASE WHEN i = 0 THEN 1 ELSE 0 END AS words FROM l
), t AS (SELECT *, (13 * words) // 10 AS t, (13 * sum(words) OVER (PARTITION BY doc_id)) // 10 <= 200 AS fits FROM w),
p AS (
  SELECT doc_id, i, t AS total, 0 AS chunk FROM t WHERE i = 0
  UNION ALL SELECT t.doc_id, t.i, CASE WHEN NOT t.fits AND p.total + t.t > 200 THEN t.t ELSE p.total + t.t END, CASE WHEN NOT t.fits AND p.total + t.t > 200 THEN p.chunk + 1 ELSE p.chunk END
  FROM p JOIN t ON t.doc_id = p.doc_id AND t.i = p.i + 1
) SELECT p.doc_id, CAST(p.chunk AS INT) AS chunk, CAST(count(*) AS INT) AS element_count, CAST((13 * sum(words)) // 10 AS INT) AS token_estimate
FROM p JOIN t ON p.doc_id = t.doc_id AND p.i = t.i GROUP BY p.doc_id, p.chunk""")
def semantic_chunks(spark, sf_dir):
    els = access.without_breaks(A.lines_corpus(spark, sf_dir))
    return chunk.semantic(els, chunk.ChunkConfig(max_tokens=200)).select("doc_id", "chunk", "element_count", "token_estimate")


@query(f"""WITH {_TURNS}, h AS (
  SELECT doc_id, pos, level,
    max(CASE WHEN level = 1 THEN pos * 100000 + turn END) OVER w AS h1, max(CASE WHEN level = 2 THEN pos * 100000 + turn END) OVER w AS h2,
    max(CASE WHEN level = 3 THEN pos * 100000 + turn END) OVER w AS h3, max(CASE WHEN level = 4 THEN pos * 100000 + turn END) OVER w AS h4
  FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), v AS (SELECT doc_id, pos, level, h1, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END AS h2, CASE WHEN h3 > greatest(coalesce(h1, -1), coalesce(h2, -1)) THEN h3 END AS h3,
  CASE WHEN h4 > greatest(coalesce(h1, -1), coalesce(h2, -1), coalesce(h3, -1)) THEN h4 END AS h4 FROM h)
SELECT doc_id, CAST(pos AS INT) AS pos, concat_ws(' > ', 'turn ' || (h1 % 100000), 'turn ' || (h2 % 100000), 'turn ' || (h3 % 100000), 'turn ' || (h4 % 100000)) AS path
FROM v WHERE level IS NULL""")
def heading_path(spark, sf_dir):
    els = access.heading_levels(A.conversation_corpus(spark, sf_dir)).where("etype = 'paragraph'")
    return els.select("doc_id", "pos", F.array_join(F.filter("path", lambda p: p != ""), " > ").alias("path"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(i * 2 AS INT) AS pos, (i % 20) / 20.0::DOUBLE AS confidence FROM l WHERE i % 3 <> 0 AND (i % 20) / 20.0::DOUBLE < 0.5")
def flagged_for_review(spark, sf_dir):
    return access.flagged(A.lines_corpus(spark, sf_dir), 0.5).select("doc_id", "pos", "confidence")


@query(f"WITH {_LINES} SELECT doc_id, count_if(i % 4 = 0) AS furniture, count_if(i % 4 <> 0) AS body FROM l GROUP BY doc_id")
def furniture_split(spark, sf_dir):
    els = access.without_breaks(A.lines_corpus(spark, sf_dir)).withColumn("is_furniture", C("pos") % 8 == 0)
    marked = access.furniture(els).withColumn("f", F.lit(True)).unionByName(access.body(els).withColumn("f", F.lit(False)))
    return marked.groupBy("doc_id").agg(F.count_if("f").alias("furniture"), F.count_if(~C("f")).alias("body"))


@query(f"WITH {_LINES} SELECT doc_id, line AS text FROM l WHERE i = 3")
def element_lookup(spark, sf_dir):
    return access.by_id(A.lines_corpus(spark, sf_dir), "l3").select("doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id")
def layer0_text(spark, sf_dir):
    return access.layer0_text(A.lines_corpus(spark, sf_dir))


@query(f"""WITH {_SIZES} SELECT doc_id, CAST(n + 1 AS INT) AS num_rows, CAST(CASE WHEN n > 3 THEN 1 END AS INT) AS first_page, CAST(CASE WHEN n > 3 THEN (n + 2) // 3 END AS INT) AS last_page FROM s""")
def merge_tables(spark, sf_dir):
    done = merge.merge_tables(A.split_tables(spark, sf_dir)).where("etype = 'table'")
    return done.select("doc_id", F.size("rows").alias("num_rows"), C("page_range.start").alias("first_page"), C("page_range.end").alias("last_page"))


@query(None)  # similarity of strings has no SQL form; compared with a greedy loop in the tests
def merge_paragraphs(spark, sf_dir):
    return merge.merge_paragraphs(A.words_corpus(spark, sf_dir)).where("etype = 'paragraph'").select("doc_id", "pos", "text")


@query(f"WITH {_LINES} SELECT doc_id, CAST(n - 7 AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, n FROM l) WHERE n > 7")
def duplicate_ids(spark, sf_dir):
    els = access.without_breaks(A.lines_corpus(spark, sf_dir)).withColumn("element_id", F.concat(F.lit("e"), ((C("pos") / 2).cast("int") % 7).cast("string")))
    return validate.duplicate_ids(els).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, 'ref_unresolved' AS rule FROM orders WHERE o_orderkey % 7 = 0")
def unresolved_refs(spark, sf_dir):
    return validate.unresolved(parsed_orders(spark, sf_dir)).select("doc_id", "rule")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = A.orders_html(spark, sf_dir)
    # exploded from an array of one, so that each of the columns that use the rows doesn't parse them again
    return P.as_elements(html.select("doc_id", F.lit(0).alias("pos"), F.lit("table").alias("etype"), F.explode(F.array(html_rows(C("html")))).alias("rows")))


@query("""SELECT o_orderkey AS doc_id, CAST(count(l_orderkey) + 1 AS INT) AS num_rows, CAST(CASE WHEN coalesce(bool_or(l_linenumber % 2 = 0), false) THEN 3 ELSE 2 END AS INT) AS num_cols,
CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def html_table_import(spark, sf_dir):
    amount = F.aggregate(F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r["cells"], lambda c, i: i == 1), lambda c: X.try_int(c["text"]).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return html_tables(spark, sf_dir).select("doc_id", F.size("rows").alias("num_rows"), X.num_cols("rows").alias("num_cols"), amount.alias("quantity"))


@query("""SELECT o_orderkey AS doc_id, CAST(1 + count_if(l_linenumber % 2 = 1) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey HAVING bool_or(l_linenumber % 2 = 0)""")
def row_width(spark, sf_dir):
    return validate.row_widths(html_tables(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_partkey AS doc_id, p_size * 20 - 40 AS x1, p_size * 10 AS y1, p_size * 25 - 40 AS x2, CASE WHEN p_partkey % 9 = 0 THEN p_size * 10 ELSE p_size * 21 END AS y2 FROM part)
SELECT doc_id, 'bbox_negative' AS rule, 'error' AS severity FROM b WHERE x1 < 0 OR y1 < 0
UNION ALL SELECT doc_id, 'bbox_outside', 'warning' FROM b WHERE x2 > 1000 OR y2 > 1000 UNION ALL SELECT doc_id, 'bbox_area', 'error' FROM b WHERE x2 <= x1 OR y2 <= y1""")
def bbox_rules(spark, sf_dir):
    return validate.bbox_issues(A.part_boxes(spark, sf_dir)).select("doc_id", "rule", "severity")


@query("""WITH e AS (SELECT event_id AS doc_id, value / 400.0::DOUBLE AS v, event_id % 5 = 0 AS bare FROM events)
SELECT doc_id, 'overall_range' AS rule, 'error' AS severity FROM e WHERE v > 1 UNION ALL SELECT doc_id, 'no_source_hash', 'warning' FROM e WHERE bare
UNION ALL SELECT doc_id, 'confidence_range', 'error' FROM e WHERE v > 1 UNION ALL SELECT doc_id, 'confidence_low', 'info' FROM e WHERE v < 0.9::DOUBLE""")
def confidence_rules(spark, sf_dir):
    v = C("value") / F.lit(400.0)
    meta = A.table(spark, sf_dir, "events").select(C("event_id").alias("doc_id"), v.alias("overall"), F.create_map(F.lit("v"), v).alias("confidence"), F.when(C("event_id") % 5 != 0, F.lit("h")).alias("source_hash"))
    return validate.confidence_issues(meta).select("doc_id", "rule", "severity")


@query(f"""WITH {_LINES} SELECT doc_id, 'removed' AS change_type, count(*) AS n FROM l WHERE i % 11 = 10 GROUP BY 1
UNION ALL SELECT doc_id, 'modified', count(*) FROM l WHERE i % 11 <> 10 AND i % 13 = 12 GROUP BY 1""")
def diff_elements(spark, sf_dir):
    old = access.without_breaks(A.lines_corpus(spark, sf_dir))
    return diff.diff_elements(old, A.new_version(old)).groupBy("doc_id", "change_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, CAST((count(*) + 1) // 2 AS BIGINT) AS n FROM lineitem GROUP BY 1")
def diff_cells(spark, sf_dir):
    old = A.orders_corpus(spark, sf_dir)
    star = lambda c, i, j: F.struct(F.when((i % 2 == 1) & (j == 2), F.concat(c["text"], F.lit("*"))).otherwise(c["text"]).alias("text"), c["is_header"].alias("is_header"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"))
    new = old.withColumn("rows", F.transform("rows", lambda r, i: F.struct(r["is_header"].alias("is_header"), F.transform(r["cells"], lambda c, j: star(c, i, j)).alias("cells"))))
    return diff.diff_cells(old, new).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, 'quality' AS element_id, CAST(quality AS DOUBLE) AS old_value, 0.5::DOUBLE AS new_value FROM labels WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE), NULL FROM labels WHERE doc_id % 4 = 0""")
def diff_confidence(spark, sf_dir):
    labels = A.table(spark, sf_dir, "labels")
    q, t = C("quality").cast("double"), C("toxic").cast("double")
    both = lambda a, b: F.map_filter(F.create_map(F.lit("quality"), a, F.lit("toxic"), b), lambda k, v: v.isNotNull())
    old = labels.select("doc_id", both(q, t).alias("confidence"))
    new = labels.select("doc_id", both(F.when(C("doc_id") % 3 == 0, 0.5).otherwise(q), F.when(C("doc_id") % 4 != 0, t)).alias("confidence"))
    return diff.diff_confidence(old, new).select("doc_id", "element_id", C("old_value").cast("double").alias("old_value"), C("new_value").cast("double").alias("new_value"))


@query("""SELECT doc_id, 'removed' AS change_type, 'source' AS description, source AS old_value, NULL::VARCHAR AS new_value FROM documents
UNION ALL SELECT doc_id, 'added', 'n_chars', NULL, CAST(n_chars AS VARCHAR) FROM documents""")
def diff_frontmatter(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    old = docs.select("doc_id", F.create_map(F.lit("lang"), C("lang"), F.lit("source"), C("source")).alias("fields"))
    new = docs.select("doc_id", F.create_map(F.lit("lang"), C("lang"), F.lit("n_chars"), C("n_chars").cast("string")).alias("fields"))
    return diff.diff_front(old, new).select("doc_id", "change_type", "description", "old_value", "new_value")


@query("""SELECT user_id AS doc_id, event_type AS new_value, r AS seq_rank FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r > 2""")
def diff_history(spark, sf_dir):
    from pyspark.sql import Window

    ranked = A.table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    full = ranked.select(C("user_id").alias("doc_id"), (C("r") - 1).alias("seq"), C("event_type").alias("action"), C("r").cast("string").alias("agent"))
    tail = diff.diff_history(full.where("seq < 2"), full)
    return tail.select("doc_id", "new_value", F.substring_index("description", ": ", 1).cast("long").alias("seq_rank"))


@query(f"""WITH {_LINES} SELECT doc_id, string_agg(CASE WHEN i = 0 THEN '## ' ELSE '' END || line, chr(10) || chr(10) ORDER BY i) || chr(10) AS markdown FROM l GROUP BY doc_id""")
def to_markdown_doc(spark, sf_dir):
    return export.to_markdown(A.lines_corpus(spark, sf_dir))


def _order_sql(line: str, sep: str) -> str:
    """Each order's key k, columns, number of lines n and its lines as one string."""
    return f"""WITH s AS (SELECT o_orderkey AS k, count(l_orderkey) AS n, any_value(o_custkey) AS c, any_value(o_orderstatus) AS st, any_value(o_orderpriority) AS p,
coalesce(string_agg(CASE WHEN l_orderkey IS NOT NULL THEN {line} END, {sep} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS lines,
CASE WHEN o_orderkey % 7 = 0 THEN 'missing-' ELSE 't-' END || o_orderkey AS ref FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""


_HTML_CELLS = " || ".join(f"'      <td>' || {v} || '</td>' || chr(10)" for v in ("l_linenumber", "l_partkey", "CAST(l_quantity AS BIGINT)"))
_HTML_LINE = f"'    <tr>' || chr(10) || {_HTML_CELLS} || '    </tr>' || chr(10)"
_HTML_HEAD = "    <tr>\n      <th>line</th>\n      <th>part</th>\n      <th>quantity</th>\n    </tr>\n"


@query(_order_sql(_HTML_LINE, "''") + f"""
SELECT k AS doc_id, '<h1>Order ' || k || '</h1>' || chr(10) || '<div class="kv"><span class="kv-key">customer</span>: <span class="kv-value">' || c || '</span></div>' || chr(10)
|| '<div class="kv"><span class="kv-key">status</span>: <span class="kv-value">' || st || '</span></div>' || chr(10) || '<div class="kv"><span class="kv-key">priority</span>: <span class="kv-value">' || p || '</span></div>' || chr(10)
|| '<table id="t-' || k || '">
  <thead>
{_HTML_HEAD}  </thead>
  <tbody>
' || lines || '  </tbody>
</table>
' || '<p>This order has ' || n || ' lines.</p>' || chr(10) || '<a class="ref" href="#' || ref || '">table:' || ref || '</a>' AS html FROM s""")
def to_html_doc(spark, sf_dir):
    return export.to_html(A.orders_corpus(spark, sf_dir), standalone=False)


def _json_row(header: bool, *texts: str) -> str:
    """SQL for a table's row as JSON, from SQL for its texts."""
    h = str(header).lower()
    cells = " || ',' || ".join(f"""'{{"text":"' || {t} || '","bbox":null,"is_header":{h},"colspan":1,"rowspan":1}}'""" for t in texts)
    return f"""'{{"is_header":{h},"bbox":null,"cells":[' || {cells} || ']}}'"""


@query(_order_sql("',' || " + _json_row(False, "l_linenumber", "l_partkey", "CAST(l_quantity AS BIGINT)"), "''") + f"""
SELECT k AS doc_id, '{{"elements":[{{"type":"heading","level":1,"text":"Order ' || k || '"}},{{"type":"keyvaluepair","key":"customer","value":"' || c
|| '"}},{{"type":"keyvaluepair","key":"status","value":"' || st || '"}},{{"type":"keyvaluepair","key":"priority","value":"' || p
|| '"}},{{"type":"table","id":"t-' || k || '","table_id":"t-' || k || '","caption":null,"nested":false,"rows":[' || {_json_row(True, "'line'", "'part'", "'quantity'")} || lines
|| ']}},{{"type":"paragraph","text":"This order has ' || n || ' lines."}},{{"type":"crossref","ref_type":"table","ref_id":"' || ref || '"}}]}}' AS json FROM s""")
def to_json_doc(spark, sf_dir):
    return export.to_json(A.orders_corpus(spark, sf_dir))


@query("""SELECT p_partkey AS doc_id, 1 AS page, CAST(p_size * 20 AS INT) AS x1, CAST(p_size * 10 AS INT) AS y1, CAST(p_size * 25 AS INT) AS x2, CAST(p_size * 21 AS INT) AS y2, p_name AS line_text FROM part""")
def parse_spatial(spark, sf_dir):
    box = F.struct((C("p_size") * 20).alias("x1"), (C("p_size") * 10).alias("y1"), (C("p_size") * 25).alias("x2"), (C("p_size") * 21).alias("y2"))
    line = F.struct(C("p_name").alias("line_text"), box.alias("bbox"), F.lit(None).cast("array<struct<x1:int,y1:int,x2:int,y2:int>>").alias("cell_bboxes"))
    blocks = A.table(spark, sf_dir, "part").select(C("p_partkey").alias("doc_id"), F.lit(0).alias("block_idx"), F.lit(1).alias("page"), F.lit(1000).alias("grid_w"), F.lit(1000).alias("grid_h"), F.array(line).alias("annotations"))
    return P.spatial_annotations(P.parse(S.spatial(blocks))).select("doc_id", "page", "bbox.*", "line_text")


@query("SELECT s_suppkey AS doc_id, s_name AS extracted_by, s_acctbal AS overall, 'h' || s_suppkey AS source_hash FROM supplier")
def parse_metadata(spark, sf_dir):
    said = F.concat(
        F.lit("---meta\nextracted_by: "), C("s_name"), F.lit("\nconfidence:\n  overall: "), C("s_acctbal").cast("string"), F.lit("\n  e1: 0.5\nprovenance:\n  source_hash: h"), C("s_suppkey").cast("string"), F.lit("\n---/meta\n")
    )
    docs = A.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("doc_id"), said.alias("text"))
    return P.metadata(P.parse(docs)).select("doc_id", "extracted_by", "overall", "source_hash")


@query(f"WITH {_LINES} SELECT doc_id, CAST(octet_length(encode(string_agg(line, chr(10) ORDER BY i))) AS INT) AS bytes, CAST(count(*) AS INT) AS lines FROM l GROUP BY doc_id")
def render_sizes(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return export.render_sizes(("text", docs, "text")).select("doc_id", "bytes", "lines")
