"""Notes of reasoning as concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OWN_TAGS = ("thought", "reasoning")


def thoughts(notes: DataFrame) -> DataFrame:
    """Concept rows of notes (id, topic, text, tags, at); a null id is made of topic and time.

    The body is Markdown with front matter, linted; the topic is a tag.
    """
    own = F.array(*map(F.lit, OWN_TAGS), F.col("topic"))
    made = F.concat(F.lit("thought_"), T.slug(F.col("topic")), F.lit("_"), F.date_format("at", "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.sha2("text", 256), 1, 6))
    title = F.concat(F.lit("Thought: "), "topic")
    front = [
        F.lit("---"),
        F.concat(F.lit('title: "'), title, F.lit('"')),
        F.lit("type: thought"),
        F.lit("thought_type: reasoning"),
        F.concat(F.lit("topic: "), "topic"),
        F.concat(F.lit("tags: [thought, reasoning, "), "topic", F.lit("]")),
        F.concat(F.lit("created: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")),
        F.lit("---"),
        F.lit(""),
        F.coalesce("text", F.lit("")),
    ]
    return notes.select(
        F.coalesce("id", made).alias("id"),
        F.lit("thought").alias("type"),
        title.alias("title"),
        F.concat(F.lit("Reasoning about "), "topic").alias("description"),
        F.lit(None).cast("string").alias("resource"),
        T.tag_union(own, F.col("tags")).alias("tags"),
        F.col("at").cast("timestamp").alias("timestamp"),
        T.linted(F.concat_ws("\n", *front)).alias("body"),
        F.create_map().cast("map<string,string>").alias("extra"),
    )
