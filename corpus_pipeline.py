"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs; all but the last return the columns of documents. Rows keep their integer doc_id to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import minmax, mixing, packing, quality, substrings
from strataframe.llm._links import bounded
from strataframe.llm._store import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold that preference pairs of labelled documents give.

    A null, empty or very long text is scored as any other, and a score equal to the threshold stays; rows that repeat an id
    stay or go each by its text; without labels of both qualities all stay; an empty table stays empty; other columns pass
    unread, whatever their names.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text")), model)
    return scored.filter(F.col("score") >= quality.CUT).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; of rows that repeat an id, the least row.

    Null ids and null or blank texts stay, as they are near nothing; a text of any length counts whole; an empty table stays
    empty; other columns pass unread, whatever their names.
    """
    gone = materialise(minmax.near_duplicates(docs).filter(~F.col("kept")).select(F.col("id").alias("__gone")).distinct(), "gone")
    left = docs.join(bounded(gone), docs["doc_id"] == gone["__gone"], "left_anti")
    repeated = materialise(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    twice = bounded(repeated.withColumnRenamed("doc_id", "__twice"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = left.join(twice, F.col("doc_id") == F.col("__twice"), "left_semi").groupBy("doc_id").agg(F.min(row).alias("__row")).select("__row.*")
    return left.join(twice, F.col("doc_id") == F.col("__twice"), "left_anti").union(least)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a document of nothing else goes.

    A null, blank or short text stays as it is, and so does a text of which nothing is removed; a text of any length is
    judged whole; rows that repeat an id are rows of their own; an empty table stays empty; other columns pass unread,
    whatever their names.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text"))
    found = substrings.remove_repeats(held).filter("n_removed = 0 or n_removed < n_words")
    changed = {
        "text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")),
        "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources take them.

    Null is a source of its own; a null or blank text has no words, and is taken as often as others of its source; a text of
    any length is taken whole or not; rows that repeat an id are rows of their own; an empty table stays empty; other
    columns pass unread, whatever their names.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source")
    return mixing.emitted(mixing.mix(held)).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence that each is packed into.

    A null or blank text has one piece of no words; a text longer than a sequence has several; rows that repeat an id are
    items of their own; equal sizes go in the order of their ids; an empty table has no pieces; other columns don't come
    along.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn a model and deal by hashes; SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
