"""Helpers of document conversion: HTML tables, asset staging, page routing, monospace and gallery blocks."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTES = ("never", "auto", "surgical", "always")
#: A page is taken the heavy way with more than so many mathematical characters and more than this share of all, or with
#: an image and fewer characters than a text page has.
MATH_CHARS, MATH_SHARE, FEW_CHARS = 30, 0.02, 50
#: Greek, mathematical operators, supplemental operators, symbols A and B, alphanumeric symbols.
MATH = r"[\x{370}-\x{3FF}\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{1D400}-\x{1D7FF}]"
#: Parts of the names of mathematical and of fixed-width fonts.
MATH_FONTS = ("cmmi", "cmsy", "cmex", "msam", "msbm", "math", "symbol", "mathjax", "stix", "xits", "asana", "euclid", "cmr10")
FIXED_FONTS = ("mono", "courier", "consol", "menlo", "inconsolata", "sourcecode", "dejavu sans mono", "fixed", "terminal")


_CELL = re.compile(r"<(t[dh])\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]\s*>|</tr\b|</table\b|\Z)", re.S | re.I)
_SPANS = re.compile(r"\b(?:col|row)span\s*=\s*[\"']?\s*(?!1\b)[^\s\"'>]", re.I)


def _cell_text(inner: str) -> str:
    bare = re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", inner, flags=re.I))
    return " ".join(html.unescape(bare).split()).replace("|", "\\|")


def pipe_table(source: str) -> str:
    """An HTML table as a pipe table, its first row with a header cell on top; one whose cells span is left as it is."""
    found = [_CELL.findall(row) for row in re.split(r"<tr\b[^>]*>", source, flags=re.I)]
    found = [cells for cells in found if cells]
    if not found or any(_SPANS.search(attributes) for cells in found for _, attributes, _ in cells):
        return source
    top = next((k for k, cells in enumerate(found) if any(kind.lower() == "th" for kind, _, _ in cells)), 0)
    width = max(map(len, found))
    lines = [[*(_cell_text(inner) for _, _, inner in cells), *[""] * (width - len(cells))] for cells in found]
    lines.insert(0, lines.pop(top))
    lines.insert(1, ["---"] * width)
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)


_TABLE = re.compile(r"<table\b.*?</table\s*>", re.S | re.I)


def _piped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _TABLE.sub(lambda m: pipe_table(m[0]), t))


def pipe_tables(text: Column | str) -> Column:
    """A text with its HTML tables as pipe tables."""
    return F.pandas_udf(_piped, "string")(text)


def route(mode: str, n_chars: Column, n_math: Column, n_images: Column) -> Column:
    """``fast`` or ``heavy``, ``surgical`` where only regions are: how a page is converted."""
    if mode not in ROUTES:
        raise ValueError(f"no routing mode {mode!r}; there are {ROUTES}")
    if mode == "never":
        return F.lit("fast")
    if mode == "always":
        return F.lit("heavy")
    math = (n_math > MATH_CHARS) & (n_math > n_chars * MATH_SHARE)
    scanned = (n_chars < FEW_CHARS) & (n_images > 0)
    return F.when(math | scanned, "heavy" if mode == "auto" else "surgical").otherwise("fast")


def math_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MATH))


def is_math_font(name: Column) -> Column:
    return F.lower(name).rlike("|".join(map(re.escape, MATH_FONTS)))


def is_fixed_font(name: Column) -> Column:
    return F.lower(name).rlike("|".join(map(re.escape, FIXED_FONTS)))


def monospace_blocks(spans: DataFrame) -> DataFrame:
    """(page, y, block): words of a fixed-width font (page, x, y, text) as fenced lines, those of over four characters."""
    line = F.sort_array(F.collect_list(F.struct("x", "text")))
    lines = spans.groupBy("page", F.round("y", 1).alias("y")).agg(F.array_join(F.transform(line, lambda s: s["text"]), " ").alias("line"))
    return lines.filter(F.length("line") > 4).select("page", "y", F.concat(F.lit("```\n"), "line", F.lit("\n```")).alias("block"))


def with_gallery(pages: DataFrame) -> DataFrame:
    """Pages (page, text, images) with images appended that no link shows; pages that show one stay as they are."""
    shown = F.array_join(F.transform("images", lambda s: F.concat(F.lit("![]("), s, F.lit(")"))), "\n")
    add = ~F.col("text").rlike(r"!\[[^\]]*\]\(") & (F.size("images") > 0)
    return pages.withColumn("text", F.when(add, F.concat("text", F.lit("\n\n"), shown)).otherwise(F.col("text")))


_IMAGE = re.compile(r"(!\[[^\]]*\]\(\s*)<?([^\s>)]+)>?([^)]*\))")


def staged(text: str, stem: str, files: dict[str, bytes]) -> tuple[str, list[tuple[str, str, bytes]]]:
    """A text whose images point to staged assets, and those: (id, name, bytes)."""
    assets: list[tuple[str, str, bytes]] = []

    def swap(m: re.Match) -> str:
        data = files.get(m[2])
        if data is None:
            return m[0]
        number = len(assets) + 1
        asset = "img_" + hashlib.sha256(f"{stem}|{number}|".encode() + data).hexdigest()[:16]
        assets.append((asset, m[2].rsplit("/", 1)[-1], data))
        return f"{m[1]}asset://{asset}{m[3]}"

    return _IMAGE.sub(swap, text), assets


def staged_texts(docs: DataFrame) -> DataFrame:
    """(id, text, assets) of documents (id, text, files: map of source to bytes)."""
    schema = "id string, text string, assets array<struct<id: string, name: string, data: binary>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *staged(t or "", i, dict(f or {}))) for i, t, f in zip(batch["id"], batch["text"], batch["files"])]
            yield pd.DataFrame([(i, t, [dict(zip(("id", "name", "data"), a)) for a in found]) for i, t, found in rows], columns=["id", "text", "assets"])

    return docs.select("id", "text", "files").mapInPandas(run, schema)


def merged_boxes(boxes: list[tuple[float, float, float, float]], gap: float = 2.0) -> list[tuple[float, float, float, float]]:
    """Boxes (x0, y0, x1, y1) that touch, grown into one another."""
    out: list[tuple[float, float, float, float]] = []
    for box in sorted(boxes, key=lambda b: (b[1], b[0])):
        while True:
            near = next((o for o in out if o[0] - gap <= box[2] and box[0] - gap <= o[2] and o[1] - gap <= box[3] and box[1] - gap <= o[3]), None)
            if near is None:
                break
            out.remove(near)
            box = (min(near[0], box[0]), min(near[1], box[1]), max(near[2], box[2]), max(near[3], box[3]))
        out.append(box)
    return reading_order(out)


def reading_order(boxes: list[tuple[float, float, float, float]], line: float = 5.0) -> list[tuple[float, float, float, float]]:
    """Boxes from top to bottom, those on about one line from left to right."""
    return sorted(boxes, key=lambda b: (round(b[1] / line), b[0]))


def replaced_loosely(text: str, old: str, new: str) -> str:
    """``text`` with the first place of ``old`` replaced, whatever the white space between its words."""
    words = [re.escape(w) for w in old.split()]
    return re.sub(r"\s+".join(words), lambda _: new, text, count=1) if words else text


def latex(formula: str, inline: bool = False) -> str:
    bare = formula.strip().strip("$").strip()
    return f"${bare}$" if inline else f"$$\n{bare}\n$$"


def first_text(attempts: Sequence[Callable[[], str]], failed: list[str] | None = None) -> str:
    """The text of the first attempt that gives one; what fails is noted and the next is tried."""
    for attempt in attempts:
        try:
            if (text := attempt()) and text.strip():
                return text
        except Exception as e:  # converters fail in any way
            if failed is not None:
                failed.append(f"{getattr(attempt, '__name__', 'attempt')}: {e}")
    return ""


def cropped(box: tuple[float, float, float, float], page: tuple[float, float], scale: float, pad: float = 2.0) -> tuple[int, int, int, int]:
    """Pixels of a region whose box has its origin at the lower left, padded and kept inside the page."""
    (x0, y0, x1, y1), (width, height) = box, page
    left, right = max(0.0, x0 - pad), min(width, x1 + pad)
    top, bottom = max(0.0, height - y1 - pad), min(height, height - y0 + pad)
    return tuple(round(v * scale) for v in (left, top, right, bottom))


def surgical_page(text: str, formulas: Sequence[tuple[str, str | None]]) -> str:
    """A page's fast text with each recognised formula (as read, as LaTeX) in the place of what was read."""
    for read, recognised in formulas:
        if recognised:
            text = replaced_loosely(text, read, latex(recognised))
    return text


def structured_page(regions: Sequence[dict], whole: Callable[[], str]) -> str:
    """A page from its layout regions (kind, box, text, src) in reading order; without a layout its whole text."""
    if not regions:
        return whole()
    by_box = {tuple(r["box"]): r for r in regions}
    parts = []
    for box in reading_order(list(by_box)):
        r = by_box[box]
        text = (r.get("text") or "").strip()
        match r["kind"]:
            case "table":
                parts.append(pipe_table(text))
            case "formula":
                parts.append(latex(text))
            case "figure":
                parts.append(f"![]({r.get('src', '')})")
            case "title":
                parts.append(f"## {text}")
            case _:
                parts.append(text)
    return "\n\n".join(p for p in parts if p)


def assembled(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """(path, page, route, text) of pages (path, page, text, images, formulas, regions), each converted its way.

    A fast page keeps its text; a surgical one has recognised formulas put in the place of what was read; a heavy one is
    assembled from its layout, or surgically without one. Tables become pipe tables, and images that no link shows are
    appended.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    how = route(mode, n, math_chars(F.coalesce("text", F.lit(""))), F.size(F.coalesce("images", F.array().cast("array<string>"))))

    @F.pandas_udf("string")
    def built(texts: pd.Series, routes: pd.Series, formulas: pd.Series, regions: pd.Series) -> pd.Series:
        def one(text: str | None, way: str, found, layout) -> str:
            text = text or ""
            found = [(f["read"], f["latex"]) for f in ([] if found is None else found)]
            layout = [] if layout is None else [dict(r) for r in layout]
            if way == "fast":
                return text
            return structured_page(layout if way == "heavy" else [], lambda: surgical_page(text, found))

        return pd.Series([one(*row) for row in zip(texts, routes, formulas, regions)], dtype=object)

    each = pages.withColumn("route", how)
    each = each.withColumn("text", pipe_tables(built("text", "route", "formulas", "regions")))
    each = each.withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    return with_gallery(each).select("path", "page", "route", "text")


def documents(pages: DataFrame, mode: str = "auto", taken: DataFrame | None = None) -> DataFrame:
    """(path, target, text) of files from their pages, in order, joined by rules, under names that aren't taken yet."""
    texts = assembled(pages, mode)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    whole = texts.groupBy("path").agg(F.array_join(listed, "\n\n---\n\n").alias("text"))
    none = pages.sparkSession.createDataFrame([], "path string")
    return whole.join(versioned_names(whole.select("path"), none if taken is None else taken), "path").select("path", "target", "text")


_VERSION = re.compile(r"(\d+)(?:\.(\d+))?(?:\.(\d+))?")


def version(text: str) -> tuple[int, int, int]:
    """A version's three numbers; what is missing is 0."""
    found = _VERSION.search(text)
    if not found:
        raise ValueError(f"no version in {text!r}")
    return tuple(int(x or 0) for x in found.groups())


def tolerated(found: str, wanted: str) -> bool:
    """Whether a library's version will do: the same major number and not older."""
    a, b = version(found), version(wanted)
    return a[0] == b[0] and a >= b


def versioned_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, target) of converted files: the stem with ``.md``, and ``_v2`` and so on where names repeat or are taken."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    used = taken.select(F.regexp_replace(F.regexp_replace("path", r"\.md$", ""), r"_v\d+$", "").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    each = names.select("path", stem.alias("stem")).withColumn("k", nth).join(used, "stem", "left")
    k = F.col("k") + F.coalesce("n", F.lit(0))
    return each.select("path", F.concat("stem", F.when(k > 1, F.concat(F.lit("_v"), k)).otherwise(F.lit("")), F.lit(".md")).alias("target"))
