"""Tables given as HTML to table rows, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as X


def _entities(x: Column) -> Column:
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(c))
    return x


def html_rows(html: Column) -> Column:
    """array<row> of the table in an HTML string.

    The outermost rows and cells are read; tags inside cells are dropped. Only a first row that has
    a ``th`` is a header; spans default to 1.
    """
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    span = lambda tag, name: F.greatest(F.lit(1), X.try_int(F.regexp_extract(tag, rf"(?i){name}\s*=\s*[\"']?(\d+)", 1), 1))

    def cell(source: Column, header: Column) -> Column:
        tag = F.regexp_extract(source, r"(?is)^<t[hd]\b([^>]*)>", 1)
        inner = F.regexp_replace(F.regexp_replace(source, r"(?is)^<t[hd]\b[^>]*>|</t[hd]\s*>$", ""), r"(?s)<[^>]*>", "")
        return F.struct(X.stripped(_entities(inner)).alias("text"), header.alias("is_header"), span(tag, "colspan").alias("colspan"), span(tag, "rowspan").alias("rowspan"))

    def row(source: Column, i: Column) -> Column:
        header = (i == 0) & source.rlike(r"(?i)<th\b")
        cells = F.regexp_extract_all(source, F.lit(r"(?is)(<t[hd]\b[^>]*>.*?</t[hd]\s*>)"), 1)
        return F.struct(header.alias("is_header"), F.transform(cells, lambda c: cell(c, header)).alias("cells"))

    return F.transform(rows, row)
