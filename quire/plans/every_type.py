"""Queries over documents that hold every element type, one document for each supplier.

What goes in and what must come out are templates in which ``@k@`` stands for the supplier's key
and ``@n@`` for its name. Spark fills in the text and runs an operator; SQL fills in the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import access, chunk, diff, export, validate
from quire.operators import parse as P
from quire.operators import serialize as S
from quire.plans import adapters as A
from quire.plans.queries import query

C = F.col

TEXT = r"""# Supplier @k@ {page: 1, id: "h-@k@", confidence: 0.5}

A **bold** line of @n@ & <others>. {reading_order: 7, lang: "de", is_furniture: true}

||| table id="t-@k@" caption="Balance"
| name | value |
|---|---|
| @n@ | @k@ |
| total {cs=2} |
|||

```sql
SELECT @k@ < 5;
```

$$x_{@k@}^2$$ {math: latex}

::form field="agree" type="checkbox" value="yes"::

::form field="note" type="textarea" value="a \"b\" @k@"::

::chart type="bar" data-ref="t-@k@" x="name" y="value"::

::annotation type="highlight" confidence=0.75 text="see @n@"::

::kv key="name" value="@n@"::

![Logo of @k@](img/@k@.png) {figure: id="f-@k@"}

[^1]: Note of @k@.

- [x] first @k@
  - inner
- [ ] second

::list ordered="true" start="3"::
3. third
4. fourth

[[ref:table:t-@k@]]

[[ref:figure:f-@k@]]

> quoted @n@
> twice

---

---page-break from=1 to=2---"""



#: What the text is written as again: a quote's lines are one, an annotation's confidence is a shared field too.
WRITTEN = TEXT.replace("\n> twice", " twice").replace('text="see @n@"::', 'text="see @n@":: {confidence: 0.75}')

MARKDOWN = r"""# Supplier @k@

A **bold** line of @n@ & <others>.

*Balance*

| name               | value |
|--------------------|-------|
| @n@ | @w@ |
| total              |       |

```sql
SELECT @k@ < 5;
```

$$x_{@k@}^2$$

- [x] agree

**note**: a "b" @k@

*[Chart: bar — data from t-@k@]*

*[highlight: see @n@]*

**name**: @n@

![Logo of @k@](img/@k@.png)

[^1]: Note of @k@.

- [x] first @k@

  - inner

- [ ] second

3. third

4. fourth

[table:t-@k@]

[figure:f-@k@]

> quoted @n@ twice

---
"""

HTML = r"""<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="utf-8" />
<title>Supplier @k@</title>
<style>p{}</style>
</head>
<body>
<h1 id="h-@k@">Supplier @k@</h1>
<p>A <strong>bold</strong> line of @n@ &amp; &lt;others&gt;.</p>
<table id="t-@k@">
  <caption>Balance</caption>
  <thead>
    <tr>
      <th>name</th>
      <th>value</th>
    </tr>
  </thead>
  <tbody>
    <tr>
      <td>@n@</td>
      <td>@k@</td>
    </tr>
    <tr>
      <td colspan="2">total</td>
    </tr>
  </tbody>
</table>
<pre><code class="language-sql">SELECT @k@ &lt; 5;</code></pre>
<span class="math-block" data-latex="x_{@k@}^2">$$x_{@k@}^2$$</span>
<label><input type="checkbox" name="agree" checked /> agree</label>
<textarea name="note">a &quot;b&quot; @k@</textarea>
<div class="chart" data-type="bar" data-ref="t-@k@" data-x="name" data-y="value">[Chart: bar]</div>
<mark class="annotation" data-type="highlight">see @n@</mark>
<div class="kv"><span class="kv-key">name</span>: <span class="kv-value">@n@</span></div>
<figure id="f-@k@"><img src="img/@k@.png" alt="Logo of @k@" /><figcaption>Logo of @k@</figcaption></figure>
<aside class="footnote" id="fn-1"><sup>1</sup> Note of @k@.</aside>
<ul>
  <li><input type="checkbox" checked disabled> first @k@
    <ul>
    <li>inner</li>
    </ul>
  </li>
  <li><input type="checkbox" disabled> second</li>
</ul>
<ol start="3">
  <li>third</li>
  <li>fourth</li>
</ol>
<a class="ref" href="#t-@k@">table:t-@k@</a>
<a class="ref" href="#f-@k@">figure:f-@k@</a>
<blockquote><p>quoted @n@ twice</p></blockquote>
<hr>
</body>
</html>"""

JSON = ",".join(
    r"""{"type":"heading","id":"h-@k@","confidence":0.5,"page":1,"level":1,"text":"Supplier @k@"}
{"type":"paragraph","reading_order":7,"lang":"de","is_furniture":true,"text":"A **bold** line of @n@ & <others>."}
{"type":"table","id":"t-@k@","table_id":"t-@k@","caption":"Balance","nested":false,"rows":[{"is_header":true,"bbox":null,"cells":[{"text":"name","bbox":null,"is_header":true,"colspan":1,"rowspan":1},{"text":"value","bbox":null,"is_header":true,"colspan":1,"rowspan":1}]},{"is_header":false,"bbox":null,"cells":[{"text":"@n@","bbox":null,"is_header":false,"colspan":1,"rowspan":1},{"text":"@k@","bbox":null,"is_header":false,"colspan":1,"rowspan":1}]},{"is_header":false,"bbox":null,"cells":[{"text":"total","bbox":null,"is_header":false,"colspan":2,"rowspan":1}]}]}
{"type":"codeblock","language":"sql","code":"SELECT @k@ < 5;"}
{"type":"mathblock","expression":"x_{@k@}^2","display_mode":true}
{"type":"formfield","field_name":"agree","field_type":"checkbox","value":"yes"}
{"type":"formfield","field_name":"note","field_type":"textarea","value":"a \"b\" @k@"}
{"type":"chart","chart_type":"bar","data_ref":"t-@k@","x_field":"name","y_field":"value"}
{"type":"annotation","confidence":0.75,"annotation_type":"highlight","text":"see @n@"}
{"type":"keyvaluepair","key":"name","value":"@n@"}
{"type":"figure","caption":"Logo of @k@","source":"img/@k@.png","figure_id":"f-@k@"}
{"type":"footnote","number":1,"text":"Note of @k@."}
{"type":"listblock","ordered":false,"start":1,"items":[{"text":"first @k@","checked":true,"children":[{"text":"inner"}]},{"text":"second","checked":false}]}
{"type":"listblock","ordered":true,"start":3,"items":[{"text":"third"},{"text":"fourth"}]}
{"type":"crossref","ref_type":"table","ref_id":"t-@k@"}
{"type":"crossref","ref_type":"figure","ref_id":"f-@k@"}
{"type":"blockquote","text":"quoted @n@ twice"}
{"type":"horizontalrule"}
{"type":"pagebreak","from_page":1,"to_page":2}""".split("\n")
)

#: The whole document: frontmatter, the elements, a spatial block and metadata.
LAYERED = (
    '---dox\n{"version":"1.0","source":"@n@.pdf","pages":2}\n---\n\n' + TEXT + '\n\n---spatial page=1 grid=1000x800\nSupplier @[10,20,300,40]\nBalance @[1,2,3,4] cells=[@[5,6,7,8],@[9,10,11,12]]\n---/spatial\n\n'
    '---meta\n{"extracted_by":"@n@","confidence":{"overall":0.95},"provenance":{"source_hash":"h@k@"}}\n---/meta\n'
)
# layers that were read keep the white space they were dumped with
LAYERED_JSON = (
    '{"dox_version":"1.0","frontmatter":{"version": "1.0", "source": "@n@.pdf", "pages": 2},"elements":[' + JSON
    + '],"spatial":[{"page":1,"grid":"1000x800","annotations":[{"text":"Supplier","bbox":[10,20,300,40],"cell_bboxes":null},{"text":"Balance","bbox":[1,2,3,4],"cell_bboxes":[[5,6,7,8],[9,10,11,12]]}]}]'
    ',"metadata":{"extracted_by": "@n@", "confidence": {"overall": 0.95}, "provenance": {"source_hash": "h@k@"}}}'
)

#: (text, type, least confidence) of the chunks by element.
CHUNKS = [
    ("# Supplier @k@", "heading", 0.5),
    ("A **bold** line of @n@ & <others>.", "paragraph", None),
    ("**Balance**\n| name | value |\n|---|---|\n| @n@ | @k@ |\n| total |", "table", None),
    ("```sql\nSELECT @k@ < 5;\n```", "codeblock", None),
    ("$$x_{@k@}^2$$", "mathblock", None),
    ("agree: yes", "formfield", None),
    ('note: a "b" @k@', "formfield", None),
    ("[Chart: bar, data from t-@k@]", "chart", None),
    ("[highlight: see @n@]", "annotation", 0.75),
    ("name: @n@", "keyvaluepair", None),
    ("[Figure: Logo of @k@]", "figure", None),
    ("[^1]: Note of @k@.", "footnote", None),
    ("- first @k@\n- second", "listblock", None),
    ("3. third\n4. fourth", "listblock", None),
    ("[ref:table:t-@k@]", "crossref", None),
    ("[ref:figure:f-@k@]", "crossref", None),
    ("> quoted @n@ twice", "blockquote", None),
    ("---", "horizontalrule", None),
]

#: The next version of the text, and what changed: (type of change, type, description, old, new, id).
CHANGED = [
    ("# Supplier @k@ {", "## Seller @k@ {", [("modified", "heading", "text changed", "Supplier @k@", "Seller @k@", "h-@k@"), ("modified", "heading", "level changed", "1", "2", "h-@k@")]),
    ('caption="Balance"', 'caption="Sums"', [("modified", "table", "caption changed", "Balance", "Sums", "t-@k@")]),
    ("| total {cs=2} |", "| total {cs=2} |\n| x | y |", [("modified", "table", "row count changed", "3", "4", "t-@k@")]),
    ("```sql\nSELECT @k@ < 5;", "```python\n@k@ < 5", [("modified", "codeblock", "code changed", "SELECT @k@ < 5;", "@k@ < 5", None), ("modified", "codeblock", "language changed", "sql", "python", None)]),
    ("\n\n---\n\n", "\n\n> again\n\n", [("removed", "horizontalrule", "removed: horizontalrule", "horizontalrule", None, None), ("added", "blockquote", "added: blockquote", None, "blockquote", None)]),
    ("---page-break from=1 to=2---", "---page-break from=1 to=2---\n\n## Later\n\n||| table id=\"u-@k@\"\n| a | b |\n|||", [("added", "heading", "added: ## Later", None, "## Later", None), ("added", "table", "added: Table(u-@k@, 1×2)", None, "Table(u-@k@, 1×2)", "u-@k@")]),
]


def changes(spark, sf_dir: str) -> DataFrame:
    later = TEXT
    for old, new, _ in CHANGED:
        later = later.replace(old, new, 1)
    return diff.diff_elements(corpus(spark, sf_dir), corpus(spark, sf_dir, later))


def quoted(template: str | float | None) -> str:
    """SQL for a template filled in, a number or null."""
    if template is None:
        return "NULL"
    if not isinstance(template, str):
        return f"{template}::DOUBLE"
    out = "'" + template.replace("'", "''") + "'"
    for mark, value in (("@k@", "CAST(s_suppkey AS VARCHAR)"), ("@n@", "s_name"), ("@w@", "rpad(CAST(s_suppkey AS VARCHAR), 5, ' ')")):
        if mark in template:
            out = f"replace({out}, '{mark}', {value})"
    return out


def rows(columns: str, found: list) -> str:
    """SQL for some rows for each supplier."""
    names = [c.strip() for c in columns.split(",")]
    each = ("SELECT s_suppkey AS doc_id, " + ", ".join(f"{quoted(v)} AS {c}" for c, v in zip(names, r, strict=True)) + " FROM supplier" for r in found)
    return " UNION ALL ".join(each)


def filled(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("@k@"), C("s_suppkey").cast("string")), F.lit("@n@"), C("s_name"))


def documents(spark, sf_dir: str, template: str = TEXT) -> DataFrame:
    return A.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("doc_id"), filled(template).alias("text"))


def corpus(spark, sf_dir: str, template: str = TEXT) -> DataFrame:
    return P.elements(P.parse(documents(spark, sf_dir, template)))


@query(rows("text", [(WRITTEN,)]))
def every_type_text(spark, sf_dir):
    return S.content(corpus(spark, sf_dir))


@query(rows("markdown", [(MARKDOWN,)]))
def every_type_markdown(spark, sf_dir):
    return export.to_markdown(corpus(spark, sf_dir))


@query(rows("html", [(HTML,)]))
def every_type_html(spark, sf_dir):
    return export.to_html(corpus(spark, sf_dir), style="p{}")


@query(rows("json", [('{"elements":[' + JSON + "]}",)]))
def every_type_json(spark, sf_dir):
    return export.to_json(corpus(spark, sf_dir))


@query(rows("json", [(LAYERED_JSON,)]))
def every_layer_json(spark, sf_dir):
    parsed = P.parse(documents(spark, sf_dir, LAYERED))
    return export.to_json(P.elements(parsed), parsed.select("doc_id", "front"), P.spatial_blocks(parsed), parsed.select("doc_id", C("meta").alias("metadata")))


@query(rows("text, element_type, min_confidence", CHUNKS))
def every_type_chunks(spark, sf_dir):
    done = chunk.by_element(access.without_breaks(corpus(spark, sf_dir)))
    return done.select("doc_id", "text", F.element_at("element_types", 1).alias("element_type"), "min_confidence")


@query(rows("change_type, element_type, description, old_value, new_value, element_id", [c for _, _, found in CHANGED for c in found]))
def every_type_diff(spark, sf_dir):
    found = changes(spark, sf_dir)
    return found.select("doc_id", "change_type", "element_type", "description", "old_value", "new_value", "element_id")


@query(
    """SELECT s_suppkey AS doc_id, i AS item_idx, c AS child_idx, t AS text, x AS checked FROM supplier, LATERAL (VALUES (0, NULL, 'first ' || s_suppkey, true),
(0, 0, 'inner', NULL), (1, NULL, 'second', false), (0, NULL, 'third', NULL), (1, NULL, 'fourth', NULL)) AS v(i, c, t, x)"""
)
def list_items(spark, sf_dir):
    return P.list_items(corpus(spark, sf_dir)).select("doc_id", "item_idx", "child_idx", "text", "checked")


#: Elements that break a rule each, and the rule.
BROKEN = [
    ({"etype": "heading", "level": 7, "text": "deep"}, "heading_level", "error"),
    ({"etype": "heading", "level": 1, "text": " "}, "heading_blank", "warning"),
    ({"etype": "table"}, "table_empty", "warning"),
    ({"etype": "formfield", "field_name": ""}, "field_unnamed", "warning"),
    ({"etype": "pagebreak", "from_page": 0, "to_page": 1}, "break_below_one", "error"),
    ({"etype": "pagebreak", "from_page": 3, "to_page": 3}, "break_backwards", "error"),
    ({"etype": "pagebreak", "from_page": 1, "to_page": 2, "lang": "en"}, "break_metadata", "warning"),
    ({"etype": "chart", "data_ref": "nothing"}, "chart_unresolved", "warning"),
    ({"etype": "crossref", "ref_id": "f1"}, "ref_unresolved", "warning"),
    ({"etype": "figure", "figure_id": "f1"}, None, None),
    ({"etype": "heading", "level": 6, "text": "fine"}, None, None),
]


@query(rows("rule, severity", [r[1:] for r in BROKEN if r[1]]))
def element_rules(spark, sf_dir):
    fields = {k: type(v) for e, _, _ in BROKEN for k, v in e.items()}
    value = lambda e, k: F.lit(e.get(k)).cast({int: "int", str: "string"}[fields[k]]).alias(k)
    each = F.array(*(F.struct(F.lit(pos).alias("pos"), *(value(e, k) for k in fields)) for pos, (e, _, _) in enumerate(BROKEN)))
    els = P.as_elements(A.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("doc_id"), F.inline(each)))
    return validate.validate_elements(els).select("doc_id", "rule", "severity")


@query(
    """SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'version_missing' WHEN 1 THEN 'version_unknown' ELSE 'pages_below_one' END AS rule,
CASE s_suppkey % 4 WHEN 1 THEN 'warning' ELSE 'error' END AS severity FROM supplier WHERE s_suppkey % 4 <> 3
UNION ALL SELECT s_suppkey, 'spatial_page', 'error' FROM supplier WHERE s_suppkey % 3 = 0"""
)
def layer_rules(spark, sf_dir):
    kind = C("s_suppkey") % 4
    front = A.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("doc_id"), F.when(kind == 0, "").when(kind == 1, "9.9").otherwise("0.1").alias("version"), F.when(kind == 2, 0).otherwise(4).alias("pages"))
    blocks = A.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("doc_id"), (C("s_suppkey") % 3).cast("int").alias("page"))
    return validate.front_issues(front).unionByName(validate.spatial_page_issues(blocks)).select("doc_id", "rule", "severity")


@query(
    """SELECT s_suppkey AS doc_id, 'removed' AS change_type, 'page ' || (s_suppkey % 5) AS description FROM supplier WHERE s_suppkey % 5 <> s_suppkey % 3
UNION ALL SELECT s_suppkey, 'added', 'page ' || (s_suppkey % 3) FROM supplier WHERE s_suppkey % 5 <> s_suppkey % 3"""
)
def diff_spatial_pages(spark, sf_dir):
    pages = lambda n: A.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("doc_id"), (C("s_suppkey") % n).cast("int").alias("page"))
    return diff.diff_spatial(pages(5), pages(3)).select("doc_id", "change_type", "description")


@query("SELECT s_suppkey AS doc_id, 3 AS added, 1 AS removed, 6 AS modified, '3 added, 1 removed, 6 modified' AS summary FROM supplier")
def diff_summary(spark, sf_dir):
    counts = diff.summary(changes(spark, sf_dir))
    return counts.select("doc_id", *(C(k).cast("int").alias(k) for k in ("added", "removed", "modified")), "summary")


@query("SELECT s_suppkey AS doc_id, s_name || '.pdf' AS source, 'en' AS lang, 18 AS n FROM supplier")
def chunk_sources(spark, sf_dir):
    parsed = P.parse(documents(spark, sf_dir, LAYERED))
    done = chunk.with_document(chunk.by_element(access.without_breaks(P.elements(parsed))), P.front(parsed))
    return done.groupBy("doc_id", "source", "lang").agg(F.count("*").cast("int").alias("n"))
