"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, html_template, licenses, metric_trees, minmax, mixing, mpeg_audio, oracles, packing, periodic, pivots, quality, simple8b, substrings
from ._links import bounded
from ._store import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_template.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op2_mpeg_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.read_media(mpeg_audio.write_media(_table(spark, sf_dir, "documents")))
    seek = F.hex(F.crc32(F.array_join("frame_offsets", ",")))
    feature = F.format_string(
        "mpeg1-layer3 %d Hz %d samples %d frames sizes %s table %d/%d seek %s junk %d bad %d",
        "hertz", "samples", "frames", "rates", "table_frames", "table_bytes", seek, "junk", "bad_checksums",
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -mpeg_audio.UNIT, mpeg_audio.UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "duration",
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op6_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    base = F.transform("phrases", lambda p: p["label"])
    starts = F.transform("phrases", lambda p: p["start"])
    more = F.transform("spans", lambda s: s["label"])
    best = F.array_max(F.concat(F.transform("spans", lambda s: s["share"]), F.transform("phrases", lambda p: F.lit(1.0))))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def op8_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op9_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simple8b.read_tokens(simple8b.write_tokens(docs, simple8b.public_tokenizer("byte_bpe_50k.json")))


def op10_difference_cover_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _with_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one text of ten, all from some word on repeats that word and those after it."""
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("words").cast("long")
    hit = docs.select("doc_id", "text", h.alias("h")).withColumn("hit", F.coalesce(F.col("h") % 10 == 0, F.lit(False)))
    cut = hit.withColumn("words", F.when(F.col("hit"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g = F.floor(F.col("h") / 10)
    at = cut.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    begin, unit = F.slice("words", 1, F.col("a").cast("int")), F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    rest = (n - F.col("a")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return at.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(begin, again), " ")).otherwise(F.col("text")).alias("text"))


def op11_internal_pattern_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_runs(_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_metric_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = metric_trees.compressed(_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    codes = materialise(found.select("vec_id", "label", "code", "error"), "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    told = codes.join(bounded(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    total = F.least("label_error", F.lit(metric_trees.LONG).cast("decimal(38,0)")).cast("long").alias("label_error")
    return told.select("vec_id", "code", "error", total, F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_salted_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.equal_texts(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_template_main_text,
        op2_mpeg_payloads,
        op3_best_fit_packing,
        op4_systematic_mixing,
        op5_bradley_terry_quality,
        op6_pivot_near_vectors,
        op7_license_diagonals,
        op8_minmax_near_duplicates,
        op9_simple8b_tokens,
        op10_difference_cover_repeats,
        op11_internal_pattern_runs,
        op12_metric_tree_codes,
        op13_salted_exact_duplicates,
    )
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
