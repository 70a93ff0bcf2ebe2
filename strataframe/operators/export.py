"""Back to linked Markdown: selection, See Also and Cited By sections, index pages, files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import all_tags, below


def select(concepts: DataFrame, subtree: str | None = None, type_: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Concepts of a subtree (five levels), a type and all of ``tags``."""
    out = concepts
    if subtree is not None:
        out = out.filter(below(F.col("id"), subtree, 5))
    if type_ is not None:
        out = out.filter(F.col("type") == type_)
    return out.filter(all_tags(F.col("tags"), tags)) if tags else out


def _titled(concepts: DataFrame, id_col: str) -> DataFrame:
    title = F.coalesce("title", F.element_at(F.split("id", "/"), -1))
    return concepts.select(F.col("id").alias(id_col), title.alias("title"))


def _lines(rows: DataFrame, other: str, name: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("title", F.col(other).alias("other"))))
    line = F.transform(listed, lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["other"], F.lit(".md)")))
    return rows.groupBy("id").agg(F.array_join(line, "\n").alias(name))


def see_also(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, see_also): what each concept links to and its body doesn't, by title."""
    rows = links.join(concepts.select(F.col("id").alias("src"), "body"), "src").join(_titled(concepts, "dst"), "dst")
    return _lines(rows.filter(~F.contains("body", F.concat("dst", F.lit(".md)")))).withColumnRenamed("src", "id"), "dst", "see_also")


def cited_by(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cited_by): what links to each concept, by title."""
    return _lines(links.join(_titled(concepts, "src"), "src").withColumnRenamed("dst", "id"), "src", "cited_by")


def index_pages(concepts: DataFrame) -> DataFrame:
    """(dir, page): for each directory all concepts below it, by title."""
    parts = F.split("id", "/")
    depth = F.size(parts) - 1
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    each = concepts.select("id", F.coalesce("title", F.element_at(parts, -1)).alias("title"), parts.alias("p"), F.explode(levels).alias("k"))
    each = each.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("dir"), "title", F.substr("id", F.length(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/")) + 2).alias("rel"))
    listed = F.sort_array(F.collect_list(F.struct("title", "rel")))
    line = F.transform(listed, lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["rel"], F.lit(".md)")))
    return each.groupBy("dir").agg(F.array_join(line, "\n").alias("page"))


def documents(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text): Markdown with front matter, body and link sections."""
    joined = concepts.join(see_also(concepts, links), "id", "left").join(cited_by(concepts, links), "id", "left")

    def quoted(c: str):
        return F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)

    front = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), quoted(c))) for c in ("type", "title", "description") if c in concepts.columns]
    if "tags" in concepts.columns:
        front.append(F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.to_json("tags"))))
    if "extra" in concepts.columns:
        front.append(F.when(F.size("extra") > 0, F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit(": "), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2))), "\n")))
    sections = [F.concat(F.lit(f"## {title}\n\n"), F.col(c)) for title, c in (("See Also", "see_also"), ("Cited By", "cited_by"))]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n"), F.concat_ws("\n\n", F.rtrim(F.coalesce("body", F.lit(""))), *sections), F.lit("\n"))
    return joined.select("id", text.alias("text"))


def write_files(texts: DataFrame, folder: str) -> None:
    """One Markdown file for each row (id, text), below a folder of any file system that all machines share.

    Rows are written where they are, as files of the folder; on a local path by the system, elsewhere by Arrow's file systems.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                path = f"{root.rstrip('/')}/{i}.md"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write((text or "").encode())
            yield batch.slice(0, 0).select(["id"])

    texts.select("id", "text").mapInArrow(write, "id string").count()
