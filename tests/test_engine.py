"""Operators on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import access, chunk, diff, export, merge, validate
from quire.operators import parse as P
from quire.operators import serialize as S
from quire.sources import layout_json
from quire.sources.html_table import html_rows

DOC = """---dox
version: "1.0"
source: a.pdf
pages: 2
---

# Report {id: "h"}

Some *text* with `code` & a [link](https://x.org) and [bad](javascript:x).

||| table id="t1" caption="Cap"
| a | b |
|---|---|
| 1 | 2 {rs=2} |
| 3 |
|||

- one
  - [x] two
- [ ] three

::form field="ok" type="checkbox" value="true"::

::chart type="bar" data-ref="none"::

[[ref:table:t1]]

[[ref:table:t9]]

[^2]: A note.

$$x^2$$ {math: latex}

```py
print("<a>")
```

> said

![cap](s.png) {figure: id="f1"}

---page-break from=1 to=2---

---

::kv key="k" value="v"::

---spatial page=1 grid=100x100
Line @[1,2,300,4] cells=[@[5,5,5,5]]
---/spatial

---meta
extracted_by: us
confidence:
  overall: 1.5
  elements:
    h: 0.5
version_history:
  - {ts: "2024-01-02T03:04:05Z", agent: a, action: made}
---/meta
"""


@pytest.fixture(scope="module")
def corpus(spark):
    df = P.parse(spark.createDataFrame([("d", DOC), ("e", ""), ("n", None)], "doc_id string, text string"))
    return P.Corpus(df.persist())


def test_layers(corpus):
    front = {r.doc_id: r for r in corpus.front.collect()}
    assert (front["d"].pages, front["d"].source, front["n"].version) == (2, "a.pdf", "1.0")
    (meta,) = corpus.metadata.collect()
    assert meta.overall == 1.5 and meta.confidence == {"h": 0.5}
    (entry,) = corpus.version_history.collect()
    assert str(entry.ts) == "2024-01-02 03:04:05" and entry.agent == "a"
    (a,) = corpus.spatial_annotations.collect()
    assert a.bbox.x2 == 300 and a.cell_bboxes[0].y1 == 5


def test_round_trip(spark, corpus):
    text = S.serialize(corpus.docs).where("doc_id = 'd'")
    again = P.Corpus(P.parse(text))
    assert diff.diff(corpus_of(corpus, "d"), again).collect() == []
    key = lambda c: [tuple(r)[1:] for r in c.elements.where("doc_id = 'd'").drop("bbox").orderBy("pos").collect()]
    assert key(corpus) == key(again)


def corpus_of(corpus, doc):
    return P.Corpus(corpus.docs.where(F.col("doc_id") == doc))


def test_headerless_table_round_trip(spark):
    text = "||| table\n|---|\n| a |\n|||"
    els = P.elements(P.parse(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    again = P.elements(P.parse(S.content(els)))
    assert [r.is_header for r in P.table_rows(again).collect()] == [False]


def test_validate(corpus):
    rules = sorted((r.rule, r.layer) for r in validate.validate(corpus).where("doc_id = 'd'").collect())
    assert rules == sorted([
        ("chart_unresolved", 0), ("ref_unresolved", 0), ("bbox_outside", 1), ("bbox_area", 1), ("overall_range", 2), ("no_source_hash", 2), ("confidence_low", 2),
    ])
    assert not validate.summary(validate.validate(corpus)).where("doc_id = 'd'").first().is_valid


def test_exports(corpus):
    els = corpus_of(corpus, "d").elements
    html = export.to_html(els).first().html
    assert "<title>Report</title>" in html and '<a href="https://x.org">link</a> and bad.' in html and "<em>text</em>" in html and "&lt;a&gt;" in html
    assert '<td rowspan="2">2</td>' in html and '<input type="checkbox" checked disabled> two' in html
    md = export.to_markdown(els).first().markdown
    assert "| a   | b   |\n|-----|-----|\n| 1   | 2   |\n| 3   |     |" in md and "- [x] ok" in md and "page-break" not in md
    import json

    data = json.loads(export.to_json(els, corpus_of(corpus, "d").docs).first().json)
    assert data["frontmatter"]["pages"] == 2 and data["elements"][2]["rows"][1]["cells"][1]["rowspan"] == 2
    assert data["elements"][3]["items"][0]["children"] == [{"text": "two", "checked": True}]


def rows(spark, data, names):
    return P.as_elements(spark.createDataFrame(data, names))


def test_heading_path_and_chunks(spark):
    data = [(1, i, t, lv, x) for i, (t, lv, x) in enumerate([("paragraph", None, "p0"), ("heading", 1, "A"), ("heading", 3, "B"), ("paragraph", None, "p1 " * 9), ("paragraph", None, "p2 " * 9), ("heading", 2, "C"), ("paragraph", None, "p3")])]
    els = rows(spark, data, "doc_id long, pos int, etype string, level int, text string")
    paths = {r.pos: list(r.path) for r in access.heading_levels(els).collect()}
    assert paths == {0: [], 1: ["A"], 2: ["A", "", "B"], 3: ["A", "", "B"], 4: ["A", "", "B"], 5: ["A", "C"], 6: ["A", "C"]}
    got = [(r.chunk, r.element_count, r.heading_path) for r in chunk.semantic(els, chunk.ChunkConfig(max_tokens=14)).orderBy("chunk").collect()]
    assert got == [(0, 1, ""), (1, 1, "A"), (2, 2, "A > B"), (3, 1, "A > B"), (4, 2, "A > C")]
    assert [r.element_count for r in chunk.chunk(els, "by_heading").orderBy("chunk").collect()] == [1, 4, 2]
    assert chunk.chunk(els, "by_element").count() == 7 and chunk.to_langchain(chunk.chunk(els)).columns == ["page_content", "metadata"]


def packed_by_hand(tokens, total, most, overlap):
    if total <= most:
        return [(0, len(tokens) - 1)]
    out, a, held = [], 0, 0
    for i, t in enumerate(tokens):
        if held + t > most and i > a:
            out.append((a, i - 1))
            k, s = i, 0
            while k > a and overlap > 0 and s + tokens[k - 1] <= overlap:
                k -= 1
                s += tokens[k]
            a, held = k, s
        held += t
    return [*out, (a, len(tokens) - 1)]


@pytest.mark.parametrize("overlap", [0, 6])
def test_packing_against_a_loop(spark, overlap):
    rng = random.Random(overlap)
    data = [(i, [rng.randint(0, 12) for _ in range(rng.randint(1, 25))]) for i in range(60)]
    df = spark.createDataFrame(data, "i int, t array<int>")
    got = df.select("i", chunk.packed_ranges(F.col("t"), F.aggregate("t", F.lit(0), lambda a, x: a + x), 20, overlap).alias("r")).collect()
    for r in got:
        t = data[r.i][1]
        assert [(x.a, x.b) for x in r.r] == packed_by_hand(t, sum(t), 20, overlap), t


def test_merge(spark):
    seq = ["paragraph", "pagebreak", "paragraph", "pagebreak", "paragraph", "paragraph", "pagebreak", "paragraph"]
    text = ["pharma-", None, "ceutical use of", None, "it. Then", "ends here.", None, "New"]
    data = [(1, i, e, t, 1 if e == "pagebreak" else None, 2 if e == "pagebreak" else None) for i, (e, t) in enumerate(zip(seq, text))]
    els = rows(spark, data, "doc_id long, pos int, etype string, text string, from_page int, to_page int")
    done = merge.merge(els, merge.MergeConfig(remove_page_breaks=True))
    assert [r.text for r in done.orderBy("pos").collect()] == ["pharmaceutical use of", "it. Then", "ends here.", "New"]
    stats = merge.merge_stats(els, done).first()
    assert (stats.paragraphs_merged, stats.page_breaks_removed) == (1, 3)
    joined = spark.createDataFrame([("the end of the line", "of the line goes on", ""), ("a", "b", "")], "a string, b string, c string").select(X.overlap_join(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in joined.collect()] == ["the end of the line goes on", "a b"]


def test_merge_runs_against_a_loop(spark):
    rng, data, want = random.Random(3), [], {}
    for d in range(40):
        els = [rng.choice(["paragraph", "paragraph", "pagebreak"]) for _ in range(rng.randint(1, 14))]
        texts = [rng.choice(["go on", "stop."]) if e == "paragraph" else None for e in els]
        data += [(d, i, e, t) for i, (e, t) in enumerate(zip(els, texts))]
        i, out, gone = 0, [], set()
        while i < len(els):
            if els[i : i + 3] == ["paragraph", "pagebreak", "paragraph"] and texts[i] == "go on":
                out.append((i, texts[i] + " " + texts[i + 2]))
                gone.add(i + 2)
                i += 3
            else:
                i += 1
        left = {i: t for i, (e, t) in enumerate(zip(els, texts)) if e == "paragraph" and i not in gone}
        left.update(out)
        want.update({(d, i): t for i, t in left.items()})
    els = rows(spark, data, "doc_id long, pos int, etype string, text string")
    got = {(r.doc_id, r.pos): r.text for r in merge.merge_paragraphs(els).where("etype = 'paragraph'").collect()}
    assert got == want


def test_pages_from_spatial(spark):
    els = rows(spark, [(1, 0, "paragraph", "Hello world of text"), (1, 1, "paragraph", "nothing like it at all")], "doc_id long, pos int, etype string, text string")
    notes = spark.createDataFrame([(1, 0, 0, 4, "Other"), (1, 1, 0, 5, "Hello world of texts")], "doc_id long, block_idx int, ann_idx int, page int, line_text string")
    assert {r.pos: r.page for r in merge.pages_from_spatial(els, notes).collect()} == {0: 5, 1: None}


def test_diff_of_spatial_and_keys(spark):
    a = rows(spark, [(1, 0, "heading", 1, "A"), (1, 1, "paragraph", None, "x")], "doc_id long, pos int, etype string, level int, text string")
    b = rows(spark, [(1, 0, "heading", 1, "B"), (1, 1, "paragraph", None, "y")], "doc_id long, pos int, etype string, level int, text string")
    got = sorted((r.change_type, r.element_type) for r in diff.diff_elements(a, b).collect())
    assert got == [("added", "heading"), ("modified", "paragraph"), ("removed", "heading")]


def test_html_rows(spark):
    html = "<table><thead><tr><th>A &amp; B</th><TH colspan=2>c</TH></tr></thead><tr><td rowspan='2'><b>x</b> y</td><td></td></tr></table>"
    (r,) = spark.createDataFrame([(html,)], "h string").select(html_rows(F.col("h")).alias("rows")).collect()
    assert [(row.is_header, [(c.text, c.colspan, c.rowspan) for c in row.cells]) for row in r.rows] == [(True, [("A & B", 1, 1), ("c", 2, 1)]), (False, [("x y", 1, 2), ("", 1, 1)])]


def test_layout_json(spark, tmp_path):
    import json

    page = lambda n, dets: {"page_info": {"page_no": n, "width": 100, "height": 200, "page_attribute": {"language": "english"}}, "layout_dets": dets}
    dets = [
        {"category_type": "title", "order": 2, "poly": [10, 20, 50, 20, 50, 40, 10, 40], "text": "A title", "anno_id": "1"},
        {"category_type": "text_block", "order": 1, "poly": [0, 0, 1, 1], "text": "Body"},
        {"category_type": "abandon", "text": "gone"},
        {"category_type": "equation_isolated", "latex": "$$a$$"},
    ]
    (tmp_path / "a.json").write_text(json.dumps([page(0, dets), page(4, [{"category_type": "table", "html": "<table><tr><td>1</td></tr></table>"}])]))
    pages = layout_json.read_pages(spark, str(tmp_path / "a.json"))
    got = [(r.etype, r.text or r.expression) for r in layout_json.to_elements(pages).orderBy("pos").collect()]
    assert got == [("paragraph", "Body"), ("heading", "A title"), ("mathblock", "a"), ("pagebreak", None), ("table", None)]
    rows = layout_json.to_elements(pages).orderBy("pos").collect()
    assert [(r.page, r.from_page, r.to_page) for r in rows] == [(1, None, None)] * 3 + [(None, 1, 2), (5, None, None)]
    blank = {"category_type": "text_block", "order": 3, "poly": [0, 0, 1, 1], "text": " "}
    (tmp_path / "b.json").write_text(json.dumps([page(0, [*dets, blank])]))
    assert len(layout_json.to_spatial(layout_json.read_pages(spark, str(tmp_path / "b.json"))).first().annotations) == 3
    math = spark.createDataFrame([(r"\\left(",), (r"\\end{x}",), (r"\\gamma",), ("a_{1}",)], "t string")
    assert [r[0] for r in math.select(layout_json.looks_like_math(F.col("t"))).collect()] == [True, True, False, False]
    box = layout_json.to_spatial(pages).orderBy("block_idx").first().annotations[1].bbox
    assert (box.x1, box.y1, box.x2, box.y2) == (100, 100, 500, 200)
    assert layout_json.language(pages).first().lang == "en"
    f = layout_json.fonts(spark.createDataFrame([(1, s) for s in (10.0, 10.0, 12.0, 20.0)], "doc_id int, size double")).first()
    assert (f.body_size, f.mean_size) == (12.0, 13.0)


def test_tables_in_circles_and_their_pages(spark):
    from quire.operators import merge
    from quire.operators.parse import as_elements

    def table(doc, pos, name, of=None, page=None, etype="table", header=False):
        return (doc, pos, etype, name, of, page, [(header, [(f"{name}{pos}", header, 1, 1)])] if etype == "table" else None)

    ddl = "doc_id int, pos int, etype string, table_id string, continuation_of string, page int, rows array<struct<is_header:boolean,cells:array<struct<text:string,is_header:boolean,colspan:int,rowspan:int>>>>"
    rows = [table(1, 0, "a", "b", 1), table(1, 1, "b", "a", 2), table(1, 2, "c", None, 9)]  # two name each other
    rows += [table(2, i, f"t{i}", f"t{(i + 1) % 5}", i + 1) for i in range(5)]  # a circle of five
    rows += [table(3, 0, "p"), table(3, 1, "q", "p", 3)]  # the first part's page is not known
    rows += [table(4, 0, "x", None, None, header=True), table(4, 1, None, None, None, "pagebreak"), table(4, 2, "y", None, 3)]  # beside, one page known
    rows += [table(5, 0, "x", None, 2, header=True), table(5, 1, None, None, None, "pagebreak"), table(5, 2, "y", None, 3), table(5, 3, "z", "y", 4), table(5, 4, "s", "s", 7)]
    got = merge.merge_tables(as_elements(spark.createDataFrame(rows, ddl))).where("etype = 'table'").orderBy("doc_id", "pos").collect()
    seen = [(r.doc_id, r.pos, len(r.rows), r.page_range and tuple(r.page_range)) for r in got]
    assert seen == [(1, 0, 2, (1, 2)), (1, 2, 1, None), (2, 0, 5, (1, 5)), (3, 0, 2, (1, 3)), (4, 0, 2, None), (5, 0, 3, (2, 4)), (5, 4, 1, None)]


def test_unresolved_in_one_pass(spark):
    from quire.operators import validate
    from quire.operators.parse import as_elements

    rows = [(1, 0, "table", "t1", None, None, None), (1, 1, "crossref", None, "t1", None, "c1"), (1, 2, "crossref", None, "gone", None, "c2"), (1, 3, "chart", None, None, "c1", None), (1, 4, "chart", None, None, "t9", None), (2, 0, "crossref", None, "t1", None, None), (2, 1, "crossref", None, None, None, None)]
    els = as_elements(spark.createDataFrame(rows, "doc_id int, pos int, etype string, table_id string, ref_id string, data_ref string, element_id string"))
    got = validate.unresolved(els)
    assert sorted((r.doc_id, r.rule, r.element_id or "") for r in got.collect()) == [(1, "chart_unresolved", ""), (1, "ref_unresolved", "c2"), (2, "ref_unresolved", ""), (2, "ref_unresolved", "")]


def test_json_with_layers(spark):
    import json

    from quire.operators import export
    from quire.operators.parse import as_elements

    els = as_elements(spark.createDataFrame([(1, 0, "paragraph", "x"), (2, 0, "paragraph", "y")], "doc_id int, pos int, etype string, text string"))
    front = spark.createDataFrame([(1, '{"version":"1.0"}'), (2, '{"version":"1.0"}')], "doc_id int, front string")
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    blocks = spark.createDataFrame([(1, 0, 3, 1000, 900, [("a", (1, 2, 3, 4), None), ("b", None, [(5, 6, 7, 8)])])], f"doc_id int, block_idx int, page int, grid_w int, grid_h int, annotations array<struct<line_text:string,bbox:{box},cell_bboxes:array<{box}>>>")
    meta = spark.createDataFrame([(1, '{"k":1}')], "doc_id int, metadata string")
    got = {r.doc_id: json.loads(r.json) for r in export.to_json(els, front, blocks, meta).collect()}
    lines = [{"text": "a", "bbox": [1, 2, 3, 4], "cell_bboxes": None}, {"text": "b", "bbox": None, "cell_bboxes": [[5, 6, 7, 8]]}]
    assert got[1]["spatial"] == [{"page": 3, "grid": "1000x900", "annotations": lines}] and got[1]["metadata"] == {"k": 1}
    assert sorted(got[2]) == ["dox_version", "elements", "frontmatter"]


def test_queries_match_their_sql(spark):
    import duckdb

    from quire.plans import every_type
    from quire.plans.queries import ORACLE_SQL, QUERIES

    of_every_type = [n for n, f in QUERIES.items() if f.__module__ == every_type.__name__]
    assert len(of_every_type) == 13
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "orders lineitem documents labels events part supplier conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("parse_order_tables", "merge_tables", "unresolved_refs", "html_table_import", "semantic_chunks", "diff_elements", "heading_path", "to_html_doc", "to_json_doc", *of_every_type):
        df = QUERIES[name](spark, d)
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        want = sorted([tuple(r) for r in cur.fetchall()], key=repr)
        assert want, name
        assert sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr) == want, name
