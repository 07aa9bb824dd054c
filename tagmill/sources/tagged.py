"""Tagged documents in files as logical tables: one JSON file a document, any store that Spark reads.

A file holds filename, pages (each with width, height, spans and annotations), metadata and
tree, a node with type, place in page, attributes and content: strings, numbers of marks,
and nodes. Files are read as a stream of each task's own; what can't be read, or not as
such a document, is a row of load_errors and keeps no other file from being read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that a folder of documents gives, and their columns.
TABLES = {
    "documents": "doc_id string, filename string, page_count long, has_structure boolean",
    "nodes": "doc_id string, node_id long, parent_id long, place long, type string, page long, actual string, alt string, expansion string, lang string",
    "items": "doc_id string, node_id long, place long, text string, mcid long",
    "spans": "doc_id string, page long, mcid long, seq long, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags long",
    "annotations": "doc_id string, page long, annot_id long, subtype string, contents string, alt string, destination string, x0 double, y0 double, x1 double, y1 double",
    "metadata": "doc_id string, name string, value string",
    "load_errors": "doc_id string, error string",
}


def _tree(doc: str, root: dict) -> Iterator[tuple[str, tuple]]:
    """Rows of nodes and items, parents first, without recursion."""
    count, open_ = 0, [(root, None, 0)]
    while open_:
        node, parent, place = open_.pop()
        own, count = count, count + 1
        given = node.get("attributes") or {}
        yield "nodes", (doc, own, parent, place, str(node.get("type", "Unknown")), node.get("page"), given.get("actualtext", ""), given.get("alt", ""), given.get("e", ""), given.get("lang", ""))
        for k, child in enumerate(node.get("content") or []):
            if isinstance(child, dict):
                open_.append((child, own, k))
            elif isinstance(child, bool) or not isinstance(child, str | int):
                raise ValueError(f"content of type {type(child).__name__}")
            else:
                yield "items", (doc, own, k, child if isinstance(child, str) else None, None if isinstance(child, str) else child)


def rows_of(doc: str, data: bytes) -> Iterator[tuple[str, tuple]]:
    """(table, row) of one file's document; raises if it isn't one."""
    whole = json.loads(data)
    if not isinstance(whole, dict):
        raise ValueError("not a document")
    pages = whole.get("pages") or []
    tree = whole.get("tree")
    yield "documents", (doc, whole.get("filename"), len(pages), bool(tree))
    for name, value in sorted((whole.get("metadata") or {}).items()):
        yield "metadata", (doc, name, None if value is None else str(value))
    for k, page in enumerate(pages):
        for i, s in enumerate(page.get("spans") or []):
            yield "spans", (doc, k, s.get("mcid", -1), i, s.get("text", ""), *map(float, s.get("bbox") or (0, 0, 0, 0)), s.get("font", ""), float(s.get("size", 0)), s.get("flags", 0))
        for i, a in enumerate(page.get("annotations") or []):
            yield "annotations", (doc, k, i, a.get("subtype", ""), a.get("contents", ""), a.get("alt", ""), a.get("destination", ""), *map(float, a.get("bbox") or (0, 0, 0, 0)))
    if tree:
        yield from _tree(doc, tree)


def read(spark: SparkSession, folder: str, glob: str = "*.json") -> dict[str, DataFrame]:
    """The tables of all documents below a folder, by name; each is read from the files when it is asked for, its own rows only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def of(table: str):
        names = [c.split()[0] for c in TABLES[table].split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for path, content in zip(f["path"], f["content"], strict=True):
                    try:
                        found = list(rows_of(path, bytes(content)))  # whole or not at all
                    except Exception as fault:
                        found = [("load_errors", (path, f"{type(fault).__name__}: {fault}"))]
                    out = [row for name, row in found if name == table]
                    if out:
                        yield pd.DataFrame(out, columns=names, dtype=object)

        return files.mapInPandas(run, TABLES[table])

    return {name: of(name) for name in TABLES}


def written(frames: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """The tables as Parquet, which prunes columns and rows, and read again."""
    for name, frame in frames.items():
        frame.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return {name: frame.sparkSession.read.parquet(f"{folder}/{name}") for name, frame in frames.items()}


def described(frames: dict[str, DataFrame]) -> DataFrame:
    """doc_id, nodes, spans, annotations: how much of each document was read."""
    count = lambda name: frames[name].groupBy("doc_id").agg(F.count("*").alias(name))
    out = frames["documents"].select("doc_id")
    for name in ("nodes", "spans", "annotations"):
        out = out.join(count(name), "doc_id", "left")
    return out.fillna(0, ["nodes", "spans", "annotations"])
