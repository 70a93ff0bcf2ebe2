"""Column expressions over texts: tokens, links, slugs, overlaps, lint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is a link, and what a mention of an asset.
NOT_WORD = r"[^\p{L}\p{N}]+"
MARKDOWN_LINK = r"\[.*?\]\((.*?\.md)\)"
STRICT_LINK = r"\[[^\]]*\]\(([^()\s]*\.md)\)"
WIKI_LINK = r"\[\[(.*?)\]\]"
ASSET_MENTION = r"asset://([A-Za-z0-9_-]+)"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    """How many ``tokens`` a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))


def n_of_token(text: Column, token: str) -> Column:
    """How many of its ``tokens`` are this one."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{token}\E(?![\p{{L}}\p{{N}}])"))


def search_text(*parts: Column) -> Column:
    """Parts joined by one space; null counts as empty and keeps its place."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit(" "), F.coalesce(p, F.lit(""))]
    return F.concat(*out[1:])


def shortened(text: Column, most: int) -> Column:
    """The first ``most`` characters, with an ellipsis if there were more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def link_target(raw: Column) -> Column:
    """Concept id of a link's target: from the root, without dots and slashes in front or the suffix."""
    plain = F.replace(F.ltrim(raw, F.lit("./")), F.lit("\\"), F.lit("/"))
    return F.ltrim(F.replace(plain, F.lit(".md")), F.lit("/"))


def link_targets(body: Column, strict: bool = False) -> Column:
    """Distinct targets of Markdown and wiki links of a body. Unless ``strict``, a link to something else runs on to the next
    ``.md)``."""
    md = F.regexp_extract_all(body, F.lit(STRICT_LINK if strict else MARKDOWN_LINK), 1)
    wiki = F.transform(F.regexp_extract_all(body, F.lit(WIKI_LINK), 1), lambda t: F.trim(t))
    return F.array_distinct(F.transform(F.concat(md, wiki), link_target))


def link_source_only(link: Column) -> Column:
    """What a Markdown link or image points to, without a title or angle brackets."""
    return F.regexp_extract(link, r"\]\(\s*<?([^\s>)]+)>?(?:\s+[\"'][^)]*)?\s*\)", 1)


def last_words(text: Column, n: int) -> Column:
    """The last ``n`` words, joined by two spaces."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), "  ")


def slug(text: Column, most: int = 30) -> Column:
    return F.substring(F.replace(F.lower(text), F.lit(" "), F.lit("_")), 1, most)


def prefixed(text: Column, prefix: str) -> Column:
    """``text`` with the encoder's prefix, unless it has it."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def tag_union(*tags: Column) -> Column:
    """Tags of several lists, each once, in order; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(t.cast("array<string>"), none) for t in tags))))


def asset_mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ASSET_MENTION), 1))


def default_title(stem: Column) -> Column:
    return F.translate(stem, "_-", "  ")


def concept_id(path: Column) -> Column:
    """Path below the root without its last suffix, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^./]+$", "")


def trailing_blanks(text: Column) -> Column:
    """Lines that end in blanks (lint rule 9)."""
    return F.regexp_count(text, F.lit(r"(?m)[ \t]+$"))


def blank_runs(text: Column) -> Column:
    """Runs of more than two newlines (lint rule 12)."""
    return F.regexp_count(text, F.lit("\n{3,}"))


def no_final_newline(text: Column) -> Column:
    """1 where the text doesn't end in a newline (lint rule 47)."""
    return (~F.endswith(text, F.lit("\n"))).cast("int")


def heading_jumps(text: Column) -> Column:
    """Headings that go down more than one level at once (lint rule 1)."""
    levels = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s"), 1), lambda h: F.length(h))
    pairs = F.arrays_zip(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))).alias("a"), F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))).alias("b"))
    return F.size(F.filter(pairs, lambda p: p["b"] > p["a"] + 1))


def crowded_fences(text: Column) -> Column:
    """Opening or closing fences right below or above other text (lint rule 31): lines before an odd fence or after an even one."""
    marked = F.split(text, "\n")
    fences = F.filter(F.transform(marked, lambda line, k: F.when(line.rlike(r"^\s{0,3}(```|~~~)"), k).otherwise(-1)), lambda k: k >= 0)

    def crowded(k: Column, nth: Column) -> Column:
        beside = F.when(nth % 2 == 0, F.get(marked, k - 1)).otherwise(F.get(marked, k + 1))
        return F.coalesce(F.trim(beside) != "", F.lit(False)).cast("int")

    return F.aggregate(F.transform(fences, crowded), F.lit(0), lambda a, b: a + b)


def inline_html(text: Column) -> Column:
    """HTML tags in a text (lint rule 33)."""
    return F.regexp_count(text, F.lit(r"</?[A-Za-z][^>\n]*>"))


def preview(title: Column, kind: Column, body: Column, most: int = 80) -> Column:
    """A line for lists: title, type and the first words of a body."""
    flat = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))
    return F.format_string("%s [%s] %s", title, kind, shortened(flat, most))


def linted(text: Column) -> Column:
    """The text with those three mended."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), "\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(out, "\n+$", ""), F.lit("\n"))


def encoded_extra(value: Column) -> Column:
    return F.to_json(value)


def decoded_extra(value: Column) -> Column:
    """JSON text of objects and lists as a variant; other text as it is, in its string form."""
    braces = value.startswith("{") | value.startswith("[")
    return F.when(braces, F.to_json(F.try_parse_json(value))).otherwise(value)


def iso_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)
