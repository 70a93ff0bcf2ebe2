"""Folders of Markdown as concepts: scan, front matter, ids."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import bounded, materialise

SUFFIXES = (".md", ".markdown", ".txt")
KNOWN = ("type", "title", "description", "resource", "tags", "timestamp")
PARSED = (
    "type string, title string, description string, resource string, tags array<string>, timestamp string, body string, extra map<string,string>, error string"
)
_FENCE = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", re.S)


def parse(text: str) -> dict:
    """Metadata and body of a document. Keys that aren't known go to ``extra``, other values than text as JSON."""
    import yaml

    found = _FENCE.match(text)
    meta, body, error = {}, text, None
    if found:
        try:
            meta = yaml.safe_load(found[1]) or {}
            if not isinstance(meta, dict):
                raise ValueError("front matter isn't a mapping")
            body = text[found.end() :].lstrip("\n")
        except (yaml.YAMLError, ValueError) as e:
            meta, error = {}, str(e).splitlines()[0]

    def plain(v) -> str | None:
        if v is None or isinstance(v, str):
            return v
        return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else json.dumps(v, default=str)

    tags = meta.get("tags") or []
    tags = [tags] if isinstance(tags, str) else [str(t) for t in tags]
    out = {k: plain(meta.get(k)) for k in KNOWN if k != "tags"}
    return out | {"tags": tags, "body": body, "extra": {str(k): plain(v) or "" for k, v in meta.items() if k not in KNOWN}, "error": error}


def _frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t or "") for t in texts], columns=[c.split()[0] for c in PARSED.split(", ")])


def parsed(text: Column | str) -> Column:
    """``parse`` of a column, as a struct."""
    return F.pandas_udf(_frame, PARSED)(text)


def scan(spark: SparkSession, folder: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(path, modified, length, content) of the files below a folder with these suffixes, in any case; relative paths.

    Spark's reader passes over files without a byte, so those are taken from its list of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder if "://" in folder else f"file:{folder if folder.startswith('/') else '/' + folder}"
    root = re.sub(r"^file:/+", "file:/", root.rstrip("/")) + "/"
    bare = F.regexp_replace("path", r"^file:/+", "file:/")
    rel = F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).otherwise(F.element_at(F.split(bare, "/"), -1))
    listed = [(unquote(p),) for p in files.inputFiles() if p.lower().endswith(tuple(suffixes))]
    read = files.select(bare.alias("__read"))
    empty = spark.createDataFrame(listed, "path string").join(read, bare == F.col("__read"), "left_anti")
    empty = empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    named = files.unionByName(empty).select(rel.alias("path"), F.col("modificationTime").alias("modified"), "length", "content")
    return named.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


#: Seconds after which a file's time tells that it is the same; younger ones may be written twice within the clock's step.
SETTLED = 2


def snapshot(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, hash, concept_id, size, modified) of scanned files.

    known: an earlier snapshot; files of the same size and time as in it have its hash and aren't read. Times of files that
    were just written are null, so that those are read again.
    """
    made = files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), "modified")
    if known is not None:
        here = files.select("path", F.col("length").alias("size"), "modified")
        same = here.join(known.filter("modified is not null").select("path", "hash", "size", "modified"), ["path", "size", "modified"]).select("path", "hash", "size", "modified")
        same = materialise(same, "same")
        read = files.join(bounded(same.select("path")), "path", "left_anti")
        made = same.union(read.select("path", F.sha2("content", 256), "length", "modified"))
    settled = F.when(F.col("modified") < F.current_timestamp() - F.expr(f"interval {SETTLED} seconds"), F.col("modified"))
    return made.select("path", "hash", T.concept_id(F.col("path")).alias("concept_id"), "size", settled.alias("modified"))


def concepts(files: DataFrame) -> DataFrame:
    """Rows of the concept table, without embeddings, and ``error`` for front matter that can't be read."""
    each = files.select("path", parsed(F.decode("content", "UTF-8")).alias("p")).select("path", "p.*")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return each.select(
        T.concept_id(F.col("path")).alias("id"),
        F.coalesce("type", F.lit("note")).alias("type"),
        F.coalesce("title", T.default_title(stem)).alias("title"),
        "description",
        "resource",
        "tags",
        T.iso_timestamp(F.col("timestamp")).alias("timestamp"),
        "body",
        "extra",
        "error",
    )


def raw_links(concepts: DataFrame) -> DataFrame:
    """(src, target) of the links of bodies."""
    return concepts.select(F.col("id").alias("src"), F.explode(T.link_targets(F.col("body"))).alias("target")).filter("target <> ''").distinct()


def image_bytes(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (concept_id, src) with data: from data: sources, or from files (path, content) by asset id or path below the
    concept's folder or the root, in this order; null where there is none. Remote sources aren't read here.

    Sources are matched by paths alone, and contents come in by one join.
    """
    from ..functions import images as I

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    asset = F.when(F.col("path").contains("_assets/"), F.concat(F.lit("asset:"), stem))
    known = files.select("path", F.explode(F.array_compact(F.array(F.concat(F.lit("path:"), "path"), asset))).alias("key"))
    local = F.regexp_replace(F.regexp_replace("src", r"[?#].*$", ""), r"^(\./)+", "")
    wanted = F.array(
        F.when(F.col("src").startswith("asset://"), F.concat(F.lit("asset:"), F.substr("src", F.lit(9)))),
        F.concat(F.lit("path:"), F.regexp_replace("concept_id", r"[^/]*$", ""), local),
        F.concat(F.lit("path:"), local),
    )
    each = refs.select("concept_id", "src").distinct().select("concept_id", "src", F.posexplode(wanted).alias("order", "key")).join(known, "key")
    chosen = each.groupBy("concept_id", "src").agg(F.min(F.struct("order", "path")).alias("c")).select("concept_id", "src", F.col("c.path").alias("path"))
    found = chosen.join(files.select("path", "content"), "path").select("concept_id", "src", "content")
    out = refs.join(found, ["concept_id", "src"], "left")
    return out.withColumn("data", F.coalesce(I.data_bytes(F.col("src")), "content")).select(*refs.columns, "data")


def fetched(url: str, most: int = 32 << 20) -> bytes | None:
    """The bytes of a remote image; null if it can't be had or is too large."""
    from urllib.error import URLError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=10) as answer:
            data = answer.read(most + 1)
    except (URLError, OSError, ValueError):
        return None
    return data if len(data) <= most else None


def with_remote(refs: DataFrame, domains: Sequence[str], fetch: Callable[[str], bytes | None]) -> DataFrame:
    """``refs`` (src, data) with the data of remote sources that the domains allow; each source is read once."""
    from ..functions import security

    allowed = F.lower("src").rlike("^https?://") & F.col("data").isNull() & (security.source_verdict(F.col("src"), domains, remote=True) == "ok")

    @F.pandas_udf("binary")
    def read(urls: pd.Series) -> pd.Series:
        return urls.map(fetch)

    got = refs.filter(allowed).select("src").distinct().select("src", read("src").alias("__remote"))
    return refs.join(got, "src", "left").withColumn("data", F.coalesce("data", "__remote")).select(*refs.columns)


class MissingConverter(RuntimeError):
    """Raised where a format needs a library that isn't installed."""


#: A page as a reader gives it: text, then what layout and recognition found; all but the text may be missing.
PAGE = (
    "text string, images array<string>, formulas array<struct<read: string, latex: string>>, "
    "regions array<struct<kind: string, box: array<double>, text: string, src: string>>"
)


def read_pages(files: DataFrame, reader: str | Callable[[bytes], Iterable[object]]) -> DataFrame:
    """(path, page, and the columns of ``PAGE``) of PDF or office files (path, content) through a converter.

    reader: a function, or ``module:function``, from bytes to an iterable of pages, which are texts or mappings. A library is
    looked for on the driver first, so its lack is one clear error.
    """
    import importlib

    if isinstance(reader, str):
        module, name = reader.split(":")
        try:
            importlib.import_module(module)
        except ImportError as e:
            raise MissingConverter(f"reading these files needs {module}, which isn't installed") from e

    def pages_of(content: bytes) -> list[dict]:
        read = reader if callable(reader) else getattr(importlib.import_module(module), name)
        found = [{"text": p} if isinstance(p, str) else dict(p) for p in read(content)]
        return [{k: p.get(k) for k in ("text", "images", "formulas", "regions")} for p in found]

    @F.pandas_udf(f"array<struct<{PAGE.replace(' string', ': string', 1).replace('images array', 'images: array').replace('formulas array', 'formulas: array').replace('regions array', 'regions: array')}>>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(pages_of)

    return files.select("path", F.posexplode(run("content")).alias("page", "p")).select("path", "page", "p.*")


def convert_pages(files: DataFrame, reader: str | Callable[[bytes], Iterable[object]]) -> DataFrame:
    """(path, text): the texts of a file's pages as they are, joined by rules."""
    pages = read_pages(files, reader).select("path", "page", F.coalesce("text", F.lit("")).alias("text"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return pages.groupBy("path").agg(F.array_join(listed, "\n\n---\n\n").alias("text"))
