"""License scans by diagonal voting.

Texts and templates are words; every run of ``GRAM`` words is hashed. All hashes of a text are joined by Spark to the places
where templates have them, and each match votes for a diagonal: its place in the text less that in the template. Votes of a
diagonal are summed, and diagonals of one template that lie within ``DRIFT`` of each other (words put in or left out shift
the rest) are merged. A merged span that has enough runs is verified word by word: the span is widened to the template's
whole length, and the words that both have in the same order are counted; their share, 2 * common / (words of the template +
words of the span), must reach ``least``. Of verified spans that overlap only the best keeps its label: that of the largest
share, then of most words, then the first label.

Templates of up to ``SHORT`` words ("licensed under the ISC license") are notices, and any word of a notice may be what names
the license; so they match whole or not at all. Changed words cost up to ``GRAM`` runs each, so a span is verified if it has all runs but ``GRAM`` times the words that may
change, and one at least.

A phrase (``PHRASES``) is a template of which nothing may be missing: a place of it is one diagonal with all its votes; such
places are independent of spans. The templates (``license_texts``) are a fixed list of some thousand words, so their table
is bounded and broadcast. Each text also has one run of its own that joins to a row that no template has, so that texts
without a match stay. Texts of the same words are verified once.

Defined cases: a null or blank text has no words and no labels; texts shorter than a run have no label; a text of any length
is scanned whole; rows that repeat an id are scanned each for itself; a null id is kept; an empty table gives an empty
result. Other input columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._links import bounded
from ._store import materialise, small_batches
from ._words import ALNUM, Words, run_hashes, run_starts, slices
from .license_texts import passages

GRAM = 3
DRIFT = 4
LEAST = 0.8
#: Templates of up to so many words must match whole: in a notice the word that differs may be the license's name.
SHORT = 11

#: The phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The run that each text has, and the template that alone has it.
EVERY, NONE = 0x5EED5EED5EED5EED, -1

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def _grams(text: str) -> np.ndarray:
    words = Words(pa.array([text]), ALNUM, fold=True)
    return run_hashes(words.hashes(), run_starts(words.first, GRAM)[0], GRAM).view(np.int64)


def templates() -> list[tuple[int, str, str, bool]]:
    """(number, label, text, whether a phrase) of each template."""
    number = count()
    return [(next(number), label, text, phrase) for phrase, given in ((True, [(v, k) for k, v in PHRASES.items()]), (False, passages())) for label, text in given]


def least_of(n_words: int, least: float) -> float:
    """The share that a template of so many words must reach."""
    return 1.0 if n_words <= SHORT else least


def may_change(n_words: int, least: float) -> int:
    """Words of a template that may differ in a span of the same length."""
    return math.floor(n_words * (1 - least) + 1e-9)


def template_table(spark: SparkSession, least: float = LEAST) -> DataFrame:
    """(gram, template, place, label, phrase, runs, enough) of each run of each template; enough: runs of a candidate."""
    rows = [(EVERY, NONE, 0, None, False, 0, 0)]
    for number, label, text, phrase in templates():
        grams, n = _grams(text).tolist(), len(words_of(text))
        enough = len(grams) if phrase or n <= SHORT else max(1, len(grams) - GRAM * max(1, may_change(n, least)))
        rows += [(g, number, at, label, phrase, len(grams), enough) for at, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, place int, label string, phrase boolean, runs int, enough int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, n_words, w1, w2, grams): the hashes of all runs of each text and one more; w1, w2: of all its words."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), ALNUM, fold=True)
            hashes, n = words.hashes(), part.num_rows
            starts, bounds = run_starts(words.first, GRAM)
            grams = np.insert(run_hashes(hashes, starts, GRAM).view(np.int64), bounds[1:], EVERY)
            whole = [run_hashes(hashes, words.first[:-1], words.counts, lane).view(np.int64) for lane in (0, 1)]
            lists = pa.ListArray.from_arrays(pa.array(bounds + np.arange(n + 1), pa.int32()), pa.array(grams))
            columns = [pa.array(row + np.arange(n)), part.column("id"), pa.array(words.counts, pa.int64()), *map(pa.array, whole), lists]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_words", "w1", "w2", "grams"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, text)."""
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), ALNUM, fold=True)
            hashes = words.hashes()
            whole = [pa.array(run_hashes(hashes, words.first[:-1], words.counts, lane).view(np.int64)) for lane in (0, 1)]
            yield pa.RecordBatch.from_arrays([*whole, part.column("text")], ["w1", "w2", "text"])


Span = tuple[float, int, str, int, int]


def verified(words: list[str], template: list[str], label: str, start: int, last: int, place: int, end: int, least: float) -> Span | None:
    """(share, words, label, start, last) of a span; place, end: the first and last place of the template that voted.

    start, last: their places in the text. The span is widened by what of the template lies before and after, and by the
    words that may have been put in.
    """
    least = least_of(len(template), least)
    more = may_change(len(template), least) + DRIFT
    begin = max(0, start - place - more)
    window = words[begin : last + len(template) - end + more]
    blocks = [b for b in SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None

    def share(part: list) -> float:
        return 2 * sum(b.size for b in part) / (len(template) + part[-1].b + part[-1].size - part[0].b)

    while len(blocks) > 1:  # a word far off that happens to agree isn't of the span
        shorter = max(blocks[1:], blocks[:-1], key=share)
        if share(shorter) <= share(blocks):
            break
        blocks = shorter
    found = round(share(blocks), 9)
    if found < least:
        return None
    return found, len(template), label, begin + blocks[0].b, begin + blocks[-1].b + blocks[-1].size - 1


def best(spans: list[Span]) -> list[Span]:
    """Of spans that overlap the best, in their order in the text."""
    kept: list[Span] = []
    for s in sorted(set(spans), key=lambda s: (-s[0], -s[1], s[2], s[3])):
        if all(s[4] < k[3] or k[4] < s[3] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[3], s[2]))


SPANS = "array<struct<label: string, start: long, last: long, share: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, n_words, phrases, spans) of each row.

    phrases: array of (start, last, label), each place of a phrase; spans: array of (label, start, last, share), the best
    verified spans. Words count from 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs = rows.mapInArrow(_runs, "row long, id long, n_words long, w1 long, w2 long, grams array<long>")
    each = runs.select("row", "id", "n_words", "w1", "w2", F.posexplode("grams").alias("at", "gram"))
    joined = materialise(each.join(F.broadcast(template_table(spark, least)), "gram").drop("gram"), "votes")
    texts = joined.filter(F.col("template") == NONE).select("row", "id", "n_words", "w1", "w2")
    votes = joined.filter(F.col("template") != NONE).withColumn("diagonal", F.col("at") - F.col("place"))

    keys = ["row", "template", "label", "phrase", "runs", "enough"]
    places = F.collect_set("place").alias("places")
    diagonals = votes.groupBy(*keys, "w1", "w2", "id", "diagonal").agg(
        F.count("*").alias("votes"), F.min("at").cast("long").alias("start"), F.max("at").cast("long").alias("last"), places
    )
    diagonals = materialise(diagonals, "diagonals")
    whole = diagonals.filter(F.col("phrase") & (F.col("votes") == F.col("runs")))
    whole = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("last") + GRAM - 1).alias("last"), "label"))).alias("phrases"))

    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(DRIFT + 1)) > DRIFT
    merged = diagonals.filter(~F.col("phrase")).withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(by))
    held = F.array_distinct(F.flatten(F.collect_list("places")))
    merged = merged.groupBy("row", "template", "enough", "w1", "w2", "id", "span").agg(F.min("start").alias("start"), F.max("last").alias("last"), held.alias("held"))
    merged = merged.filter(F.size("held") >= F.col("enough"))
    candidate = F.struct("template", "start", "last", F.array_min("held").alias("place"), F.array_max("held").alias("end"))
    candidates = merged.groupBy("row", "w1", "w2").agg(F.min("id").alias("id"), F.collect_set(candidate).alias("spans"))
    candidates = materialise(candidates.groupBy("w1", "w2").agg(F.min("id").alias("id"), F.min_by("spans", "row").alias("spans")), "candidates")

    known = {number: (words_of(text), label) for number, label, text, _ in templates()}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = words_of(text)
                found = [verified(words, *known[s["template"]], s["start"], s["last"] + GRAM - 1, s["place"], s["end"] + GRAM - 1, least) for s in spans]
                out.append([dict(zip(("label", "start", "last", "share"), (s[2], s[3], s[4], s[0]))) for s in best([s for s in found if s])])
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("w1"), batch.column("w2"), pa.array(out, kind)], ["w1", "w2", "spans"])

    wanted = candidates.select(F.col("id").alias("__id"))
    some = rows.join(bounded(materialise(wanted.distinct(), "ids")), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    some = some.mapInArrow(_prints, "w1 long, w2 long, text string").join(bounded(candidates.select("w1", "w2")), ["w1", "w2"], "left_semi")
    some = some.groupBy("w1", "w2").agg(F.min("text").alias("text")).join(candidates.select("w1", "w2", "spans"), ["w1", "w2"])
    spans = materialise(some.mapInArrow(verify, f"w1 long, w2 long, spans {SPANS}").filter(F.size("spans") > 0), "spans")

    none = (F.expr("cast(array() as array<struct<start: long, last: long, label: string>>)"), F.expr(f"cast(array() as {SPANS})"))
    out = texts.join(whole, "row", "left").join(bounded(spans), ["w1", "w2"], "left")
    return out.select("id", "n_words", F.coalesce("phrases", none[0]).alias("phrases"), F.coalesce("spans", none[1]).alias("spans"))
