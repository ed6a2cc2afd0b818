"""Chunks for retrieval, cut along a document's structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.access import heading_levels, in_order
from quire.operators.serialize import by_type

C = F.col
STRATEGIES = ("semantic", "by_heading", "by_element", "by_page", "fixed_size")


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 512
    min_tokens: int = 50
    overlap_tokens: int = 0
    include_heading_path: bool = True
    include_table_as_markdown: bool = True
    include_confidence: bool = True
    heading_level_split: int = 2


def table_text() -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r["cells"], lambda c: c["text"]), " | "), F.lit(" |"))
    head = X.header_rows("rows")
    separator = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), X.num_cols("rows")), "|"), F.lit("|"))
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.when(C("caption") != "", F.array(F.concat(F.lit("**"), C("caption"), F.lit("**")))).otherwise(empty),
        F.when(F.size(head) > 0, F.concat(F.transform(head, line), F.array(separator))).otherwise(empty),
        F.transform(X.data_rows("rows"), line),
    )
    nothing = F.concat(F.lit("[Empty table: "), F.coalesce("table_id", F.lit("unnamed")), F.lit("]"))
    return F.when(F.coalesce(F.size("rows"), F.lit(0)) == 0, nothing).otherwise(F.array_join(parts, "\n"))


def element_text(config: ChunkConfig) -> Column:
    """An element as a reader of the chunk should see it."""
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    short = said("[Table: ", F.coalesce("table_id", F.lit("unnamed")), ", ", F.size("rows"), "×", X.num_cols("rows"), "]")
    mark = lambda i: F.when(C("ordered"), F.concat((F.coalesce("start", F.lit(1)) + i).cast("string"), F.lit("."))).otherwise(F.lit("-"))
    return by_type(
        {
            "heading": said(F.repeat(F.lit("#"), C("level")), " ", C("text")),
            "paragraph": said(C("text")),
            "table": table_text() if config.include_table_as_markdown else short,
            "codeblock": said("```", C("language"), "\n", C("code"), "\n```"),
            "mathblock": said("$$", C("expression"), "$$"),
            "formfield": said(C("field_name"), ": ", C("value")),
            "chart": said("[Chart: ", C("chart_type"), ", data from ", C("data_ref"), "]"),
            "annotation": said("[", C("annotation_type"), ": ", C("text"), "]"),
            "keyvaluepair": said(C("key"), ": ", C("value")),
            "figure": said("[Figure: ", C("caption"), "]"),
            "footnote": said("[^", C("number"), "]: ", C("text")),
            "listblock": F.array_join(F.transform("items", lambda it, i: F.concat(mark(i), F.lit(" "), it["text"])), "\n"),
            "crossref": said("[ref:", C("ref_type"), ":", C("ref_id"), "]"),
            "blockquote": said("> ", C("text")),
            "horizontalrule": F.lit("---"),
            "pagebreak": F.lit(""),
        }
    )


def packed_ranges(tokens: Column, total: Column, most: int, overlap: int) -> Column:
    """(a, b) of each chunk of a group, first and last element from 0: everything if it fits;
    otherwise greedily, an element that is too large by itself alone. With overlap, a chunk
    begins with the elements at the end of the one before whose tokens together stay within it."""

    def carried(s: Column, i: Column) -> Column:
        # elements before i, down to the chunk's first, while their sum stays within the overlap
        back = F.reverse(F.sequence(s["a"], i - 1))
        kept = F.aggregate(
            back,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("go")),
            lambda k, j: F.when(k["go"] & (k["sum"] + F.get(tokens, j) <= overlap), F.struct((k["n"] + 1).alias("n"), (k["sum"] + F.get(tokens, j)).cast("int").alias("sum"), F.lit(True).alias("go"))).otherwise(
                F.struct(k["n"].alias("n"), k["sum"].alias("sum"), F.lit(False).alias("go"))
            ),
        )
        return kept

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("sum"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))

    def step(s: Column, i: Column) -> Column:
        t = F.get(tokens, i)
        over = (s["sum"] + t > most) & (i > s["a"])
        done = F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), (i - 1).alias("b"))))
        if overlap <= 0:
            fresh = F.struct(i.alias("a"), t.alias("sum"), done.alias("done"))
        else:
            kept = carried(s, i)
            fresh = F.struct((i - kept["n"]).alias("a"), (kept["sum"] + t).cast("int").alias("sum"), done.alias("done"))
        return F.when(over, fresh).otherwise(F.struct(s["a"].alias("a"), (s["sum"] + t).cast("int").alias("sum"), s["done"].alias("done")))

    n = F.size(tokens)
    all_ = F.array(F.struct(F.lit(0).alias("a"), (n - 1).alias("b")))
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), (n - 1).alias("b")))))
    return F.when(total <= most, all_).otherwise(folded)


def _described(groups: DataFrame, config: ChunkConfig) -> DataFrame:
    """Chunks from (doc_id, grp, part, rows): text and metadata."""
    rows = C("rows")
    conf = F.array_min(F.filter(F.transform(rows, lambda r: r["confidence"]), lambda x: x.isNotNull()))
    tables = F.filter(F.transform(F.filter(rows, lambda r: r["etype"] == "table"), lambda r: r["table_id"]), lambda x: x != "")
    path = F.get(rows, F.lit(0))["path"] if config.include_heading_path else F.array().cast("array<string>")
    named = F.filter(path, lambda p: p != "")
    text = X.stripped(F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n"))
    return groups.select(
        "doc_id",
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("grp", "part")) - 1).alias("chunk"),
        text.alias("text"),
        F.array_join(named, " > ").alias("heading_path"),
        F.when(F.size(path) > 0, F.element_at(path, -1)).alias("section"),
        F.sort_array(F.array_distinct(F.transform(rows, lambda r: r["etype"]))).alias("element_types"),
        F.size(rows).alias("element_count"),
        F.when(F.size(tables) > 0, tables).alias("table_ids"),
        (conf if config.include_confidence else F.lit(None).cast("double")).alias("min_confidence"),
        F.get(rows, F.lit(0))["page"].alias("page"),
    ).withColumn("token_estimate", X.token_estimate("text"))


def _grouped(marked: DataFrame, config: ChunkConfig, limit: bool) -> DataFrame:
    """Groups by ``grp`` as rows of elements in order, cut to size."""
    e = F.struct("pos", "s", "tokens", "etype", "table_id", "confidence", "path", "page")
    groups = marked.groupBy("doc_id", "grp").agg(F.array_sort(F.collect_list(e)).alias("rows"))
    if not limit:
        return groups.withColumn("part", F.lit(0))
    whole = X.token_estimate(F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n"))
    cut = groups.select("doc_id", "grp", "rows", F.transform("rows", lambda r: r["tokens"]).alias("t"), whole.alias("total"))
    ranges = cut.select("doc_id", "grp", "rows", F.posexplode(packed_ranges(C("t"), C("total"), config.max_tokens, config.overlap_tokens)).alias("part", "r"))
    return ranges.select("doc_id", "grp", "part", F.slice("rows", C("r.a") + 1, C("r.b") - C("r.a") + 1).alias("rows"))


def with_document(chunks: DataFrame, front: DataFrame) -> DataFrame:
    """The chunks with ``source`` and ``lang`` of their document's frontmatter, null without one."""
    return chunks.join(front.select("doc_id", "source", "lang"), "doc_id", "left")


def semantic(els: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """A group begins at each heading, and a large table or code block is a group of its own."""
    c = config or ChunkConfig()
    w = in_order()
    rows = heading_levels(els).withColumn("s", element_text(c)).withColumn("tokens", X.token_estimate("s"))
    alone = C("etype").isin("table", "codeblock") & (C("tokens") > c.min_tokens)
    begins = (C("etype") == "heading") | alone | F.coalesce(F.lag(alone).over(w), F.lit(True))
    marked = rows.withColumn("b", begins.cast("int")).withColumn("grp", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _described(_grouped(marked, c, True), c)


def by_heading(els: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """One chunk for each section down to a level; deeper headings stay inside and out of the path."""
    c = config or ChunkConfig()
    w = in_order()
    rows = heading_levels(els, c.heading_level_split).withColumn("s", element_text(c)).withColumn("tokens", X.token_estimate("s"))
    begins = ((C("etype") == "heading") & (C("level") <= c.heading_level_split)).cast("int")
    return _described(_grouped(rows.withColumn("b", begins).withColumn("grp", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))), c, False), c)


def by_element(els: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    c = config or ChunkConfig()
    rows = heading_levels(els).withColumn("s", element_text(c)).withColumn("tokens", X.token_estimate("s")).withColumn("grp", C("pos"))
    return _described(_grouped(rows, c, False), c)


def by_page(els: DataFrame, config: ChunkConfig | None = None, annotated: DataFrame | None = None) -> DataFrame:
    """One chunk for each page; documents without spatial blocks (not in ``annotated``, if given),
    and those on one page with more than five elements, are cut as in ``semantic``."""
    c = config or ChunkConfig()
    rows = els.withColumn("page", F.coalesce(F.when(C("page") != 0, C("page")), F.lit(1)))
    sizes = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"))
    paged = sizes.where("pages > 1 OR n <= 5").select("doc_id")
    if annotated is not None:
        paged = paged.join(annotated.select("doc_id").distinct(), "doc_id", "left_semi")
    own = rows.join(paged, "doc_id", "left_semi").withColumn("s", element_text(c)).withColumn("tokens", X.token_estimate("s"))
    marked = own.withColumn("path", F.array().cast("array<string>")).withColumn("grp", C("page"))
    rest = els.join(paged, "doc_id", "left_anti")
    return _described(_grouped(marked, c, False), c).unionByName(semantic(rest, c))


def chunk(els: DataFrame, strategy: str = "semantic", config: ChunkConfig | None = None) -> DataFrame:
    """Chunks by one of ``STRATEGIES``; ``fixed_size`` is another name of ``semantic``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return {"by_heading": by_heading, "by_element": by_element, "by_page": by_page}.get(strategy, semantic)(els, config)


def to_langchain(chunks: DataFrame) -> DataFrame:
    """(page_content, metadata)."""
    return chunks.select(C("text").alias("page_content"), F.struct(*[c for c in chunks.columns if c != "text"]).alias("metadata"))


def to_llama_index(chunks: DataFrame) -> DataFrame:
    """(text, metadata, excluded_embed_metadata_keys)."""
    return chunks.select("text", F.struct(*[c for c in chunks.columns if c != "text"]).alias("metadata"), F.array(F.lit("element_types"), F.lit("element_count")).alias("excluded_embed_metadata_keys"))
