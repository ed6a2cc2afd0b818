"""Command line: each command is one operator over the documents at a path (a file, folder or pattern)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quire.operators import access, chunk, diff, export, validate
from quire.operators import parse as P
from quire.operators import serialize as S
from quire.operators.json_schema import json_schema_text
from quire.sources.files import read_text

COMMANDS = ("parse", "validate", "convert", "info", "strip", "diff", "chunk", "render", "schema")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        if name != "schema":
            c.add_argument("path")
        if name == "diff":
            c.add_argument("new_path")
            c.add_argument("--ignore-spatial", action="store_true")
            c.add_argument("--ignore-metadata", action="store_true")
        if name == "convert":
            c.add_argument("--to", choices=("json", "markdown", "html", "text"), default="json")
        if name == "chunk":
            c.add_argument("--strategy", choices=chunk.STRATEGIES, default="semantic")
            c.add_argument("--max-tokens", type=int, default=512)
        if name in ("validate", "info"):
            c.add_argument("--threshold", type=float, default=0.90)
        if name == "strip":
            c.add_argument("--layer", choices=("spatial", "metadata", "all"), default="all")
        c.add_argument("--output", help="folder to write to as JSON; rows are printed otherwise")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The command's rows."""
    corpus = P.Corpus(P.parse(read_text(spark, a.path)))
    if a.command == "parse":
        return access.statistics(corpus.elements).orderBy("doc_id", "etype")
    if a.command == "validate":
        return validate.validate(corpus, a.threshold)
    if a.command == "convert":
        forms = {"json": lambda: export.to_json(corpus.elements, corpus.docs), "markdown": lambda: export.to_markdown(corpus.elements), "html": lambda: export.to_html(corpus.elements), "text": lambda: S.serialize(corpus.docs)}
        return forms[a.to]()
    if a.command == "info":
        return access.toc(corpus.elements).join(access.flagged_entries(corpus.metadata, a.threshold), ["doc_id"], "left").orderBy("doc_id", "pos")
    if a.command == "strip":
        return S.serialize(corpus.docs, with_spatial=a.layer == "metadata", with_metadata=a.layer == "spatial")
    if a.command == "chunk":
        return chunk.chunk(corpus.elements, a.strategy, chunk.ChunkConfig(max_tokens=a.max_tokens))
    if a.command == "render":
        return export.to_html(corpus.elements, standalone=True)
    # versions are matched by file name
    name = lambda c: P.Corpus(c.docs.selectExpr("substring_index(doc_id, '/', -1) AS doc_id", "* EXCEPT (doc_id)"))
    return diff.diff(name(corpus), name(P.Corpus(P.parse(read_text(spark, a.new_path)))), a.ignore_spatial, a.ignore_metadata)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "schema":
        print(json_schema_text())
        return 0
    spark = SparkSession.builder.appName("quire").getOrCreate()
    rows = result(spark, a)
    if a.output:
        rows.write.mode("overwrite").json(a.output)
    else:
        for r in rows.toLocalIterator():
            print(r)
    return int(a.command == "validate" and rows.where("severity = 'error'").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
