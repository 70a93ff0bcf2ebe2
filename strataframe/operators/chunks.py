"""Splitting bodies into structural blocks, overlap payloads, and the way back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

STRUCTURAL = ("Heading", "CodeBlock", "List", "Blockquote", "Table", "Diagram")
DELIMITER = "\n\n"

_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)\s*(\w*)")
_KINDS = (
    ("Heading", re.compile(r"^\s{0,3}#{1,6}(\s|$)")),
    ("Blockquote", re.compile(r"^\s{0,3}>")),
    ("List", re.compile(r"^\s{0,3}([-*+]|\d+[.)])\s")),
    ("Table", re.compile(r"^\s*\|")),
)


def blocks(body: str) -> list[tuple[str, str, int, int]]:
    """(text, kind, start, end) of each block; offsets are bytes of UTF-8. Blank lines divide, headings stand alone."""
    out: list[tuple[str, str, int, int]] = []
    lines: list[str] = []
    kind, start, at, fence = "", 0, 0, ""

    def close() -> None:
        nonlocal lines, kind
        if lines:
            text = "".join(lines)
            kept = text.rstrip("\r\n")
            out.append((kept, kind, start, start + len(kept.encode())))
        lines, kind = [], ""

    for line in body.splitlines(keepends=True):
        mark = _FENCE.match(line)
        if fence:
            lines.append(line)
            if mark and mark[1].startswith(fence[0]) and len(mark[1]) >= len(fence) and not mark[2]:
                close()
                fence = ""
        elif mark:
            close()
            fence, kind, start, lines = mark[1], "Diagram" if mark[2].lower() in ("mermaid", "plantuml", "dot") else "CodeBlock", at, [line]
        elif not line.strip():
            close()
        else:
            mine = next((k for k, p in _KINDS if p.match(line)), "Paragraph")
            goes_on = mine == kind or (mine == "Paragraph" and kind in ("List", "Blockquote"))
            if kind and (mine == "Heading" or kind == "Heading" or not goes_on):
                close()
            if not lines:
                kind, start = mine, at
            lines.append(line)
        at += len(line.encode())
    close()
    return out


def split(docs: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    """Chunk rows of each document: id, parent_doc_id, chunk_index, chunk_text, block_type, start_offset, end_offset."""

    @F.pandas_udf("array<struct<chunk_text:string,block_type:string,start_offset:bigint,end_offset:bigint>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield bodies.map(lambda b: [dict(zip(("chunk_text", "block_type", "start_offset", "end_offset"), x)) for x in blocks(b or "")])

    each = docs.select(F.col(id_col).alias("parent_doc_id"), F.posexplode(cut(body)).alias("chunk_index", "c"))
    return each.select(
        F.concat("parent_doc_id", F.lit("#chunk:"), "chunk_index").alias("id"), "parent_doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "c.*"
    )


def overlapped(chunks: DataFrame, n_words: int = 5) -> DataFrame:
    """``chunks`` with heading, tail and payload: the latest heading, the last words of the chunk before unless that or this
    one is structural, and all that is there joined by blank lines."""
    order = Window.partitionBy("parent_doc_id").orderBy("chunk_index")
    heading = F.last(F.when(F.col("block_type") == "Heading", F.col("chunk_text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag(F.struct("chunk_text", "block_type")).over(order)
    free = ~F.col("block_type").isin(*STRUCTURAL) & ~before["block_type"].isin(*STRUCTURAL)
    with_both = chunks.withColumn("heading", heading).withColumn("before", before).withColumn(
        "tail", F.when(free, T.last_words(F.col("before")["chunk_text"], n_words))
    )
    payload = F.concat_ws(DELIMITER, F.when(F.col("block_type") != "Heading", F.col("heading")), F.when(F.col("tail") != "", F.col("tail")), "chunk_text")
    return with_both.drop("before").withColumn("payload", payload)


def delimiter(before: Column, kind: Column) -> Column:
    """What stands between two blocks: nothing before the first, a line within lists and tables, else a blank line."""
    close = (before == kind) & kind.isin("List", "Table")
    return F.when(before.isNull(), "").when(close, "\n").otherwise(DELIMITER)


def reconstruct(chunks: DataFrame, glue: str | None = None) -> DataFrame:
    """(parent_doc_id, body): chunks in order with their delimiters, or one ``glue`` throughout."""
    order = Window.partitionBy("parent_doc_id").orderBy("chunk_index")
    between = delimiter(F.lag("block_type").over(order), F.col("block_type")) if glue is None else F.when(F.col("chunk_index") == 0, "").otherwise(glue)
    parts = chunks.withColumn("part", F.concat(between, "chunk_text"))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "part")))
    return parts.groupBy("parent_doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["part"]), "").alias("body"))


def over_context(texts: DataFrame, limit: int, text: str = "chunk_text") -> DataFrame:
    """Rows whose words reach nine tenths of an encoder's limit, with n_words."""
    return texts.withColumn("n_words", F.size(T.tokens(F.col(text)))).filter(F.col("n_words") * 10 >= limit * 9)
