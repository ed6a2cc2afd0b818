"""Documents to corpus tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import text as X
from quire.operators.blockscan import parsed
from quire.schema import ELEMENT, PARSED

_ROOT = str(Path(__file__).resolve().parents[2])


def parse(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, front, elements, spatial, meta, notes): every document's layers, one row each.

    Shuffle-free: documents are scanned where they lie. A null text is an empty document.
    """
    env = corpus.sparkSession.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, env.get("PYTHONPATH", "")) if p)
    id_type = corpus.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, {PARSED}"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                rows = [parsed(t) for t in some.column("text").to_pylist()]
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(arrow.field(0).type), *columns], schema=arrow)

    return corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def elements(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, pos, …): one row for each element."""
    return parsed_docs.select("doc_id", F.inline("elements"))


def front(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, version, source, pages, lang, doc_type, extra VARIANT): frontmatter, known keys apart."""
    v = F.parse_json("front")
    known = ("version", "source", "pages", "lang", "doc_type")
    get = lambda k, kind: F.try_variant_get(v, f"$.{k}", kind)
    keys = F.filter(F.json_object_keys("front"), lambda k: ~k.isin(*known))
    return parsed_docs.select(
        "doc_id",
        F.coalesce(get("version", "string"), F.lit("1.0")).alias("version"),
        F.coalesce(get("source", "string"), F.lit("")).alias("source"),
        get("pages", "int").alias("pages"),
        F.coalesce(get("lang", "string"), F.lit("en")).alias("lang"),
        get("doc_type", "string").alias("doc_type"),
        keys.alias("extra_keys"),
        v.alias("all"),
    )


def spatial_blocks(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, block_idx, page, grid_w, grid_h, annotations)."""
    return parsed_docs.select("doc_id", F.posexplode("spatial").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


def spatial_annotations(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, block_idx, page, grid_w, grid_h, ann_idx, line_text, bbox, cell_bboxes)."""
    blocks = spatial_blocks(parsed_docs)
    return blocks.select("doc_id", "block_idx", "page", "grid_w", "grid_h", F.posexplode("annotations").alias("ann_idx", "a")).select(
        "doc_id", "block_idx", "page", "grid_w", "grid_h", "ann_idx", "a.*"
    )


def metadata(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, extracted_by, extracted_at, overall, confidence, source_hash, pipeline, all): one row for
    each document that has the layer. Confidences may stand beside ``overall`` or in ``elements`` below it."""
    v = F.parse_json("meta")
    conf = F.from_json(F.get_json_object("meta", "$.confidence"), "map<string,string>")
    nested = F.from_json(F.get_json_object("meta", "$.confidence.elements"), "map<string,double>")
    flat = F.transform_values(F.map_filter(conf, lambda k, x: ~k.isin("overall", "elements")), lambda _k, x: X.try_double(x))
    empty = F.create_map().cast("map<string,double>")
    return parsed_docs.where("meta IS NOT NULL").select(
        "doc_id",
        F.try_variant_get(v, "$.extracted_by", "string").alias("extracted_by"),
        F.try_to_timestamp(F.try_variant_get(v, "$.extracted_at", "string")).alias("extracted_at"),
        F.coalesce(X.try_double(F.get_json_object("meta", "$.confidence.overall")), X.try_double(F.get_json_object("meta", "$.confidence")), F.lit(0.0)).alias("overall"),
        F.map_concat(F.coalesce(F.map_filter(flat, lambda k, _x: ~F.coalesce(F.map_contains_key(nested, k), F.lit(False))), empty), F.coalesce(nested, empty)).alias("confidence"),
        F.try_variant_get(v, "$.provenance.source_hash", "string").alias("source_hash"),
        F.from_json(F.get_json_object("meta", "$.provenance.extraction_pipeline"), "array<string>").alias("pipeline"),
        v.alias("all"),
    )


def version_history(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, seq, ts, agent, action)."""
    entries = F.from_json(F.get_json_object("meta", "$.version_history"), "array<struct<ts:string,timestamp:string,agent:string,action:string>>")
    rows = parsed_docs.where("meta IS NOT NULL").select("doc_id", F.posexplode(entries).alias("seq", "e"))
    return rows.select("doc_id", "seq", F.try_to_timestamp(F.coalesce("e.ts", "e.timestamp")).alias("ts"), "e.agent", "e.action")


def table_rows(els: DataFrame) -> DataFrame:
    """(doc_id, pos, row_idx, is_header, cells); a row without cells stays."""
    tables = els.where("etype = 'table'")
    return tables.select("doc_id", "pos", F.posexplode("rows").alias("row_idx", "r")).select("doc_id", "pos", "row_idx", "r.is_header", "r.cells")


def table_cells(els: DataFrame) -> DataFrame:
    """(doc_id, pos, row_idx, cell_idx, is_header, text, colspan, rowspan)."""
    rows = table_rows(els).select("doc_id", "pos", "row_idx", F.posexplode("cells").alias("cell_idx", "c"))
    return rows.select("doc_id", "pos", "row_idx", "cell_idx", "c.is_header", "c.text", "c.colspan", "c.rowspan")


def list_items(els: DataFrame) -> DataFrame:
    """(doc_id, pos, item_idx, child_idx, text, checked); child_idx is null for the items themselves."""
    top = els.where("etype = 'listblock'").select("doc_id", "pos", F.posexplode("items").alias("item_idx", "i"))
    own = top.select("doc_id", "pos", "item_idx", F.lit(None).cast("int").alias("child_idx"), "i.text", "i.checked")
    below = top.select("doc_id", "pos", "item_idx", F.posexplode("i.children").alias("child_idx", "c"))
    return own.unionByName(below.select("doc_id", "pos", "item_idx", "child_idx", "c.text", "c.checked"))


def as_elements(df: DataFrame) -> DataFrame:
    """A table with some of an element's columns, completed by nulls: how adapters build elements."""
    have = set(df.columns)
    return df.select("doc_id", *(F.col(k).cast(t).alias(k) if k in have else F.lit(None).cast(t).alias(k) for k, t in ELEMENT.items()))


@dataclass(frozen=True)
class Corpus:
    """The tables of one parsed corpus, each derived on demand."""

    docs: DataFrame

    def __getattr__(self, name: str) -> DataFrame:
        of_docs = {"elements": elements, "front": front, "spatial_blocks": spatial_blocks, "spatial_annotations": spatial_annotations, "metadata": metadata, "version_history": version_history}
        of_elements = {"table_rows": table_rows, "table_cells": table_cells, "list_items": list_items}
        if name in of_docs:
            return of_docs[name](self.docs)
        if name in of_elements:
            return of_elements[name](elements(self.docs))
        raise AttributeError(name)
