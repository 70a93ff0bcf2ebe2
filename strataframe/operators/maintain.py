"""Incremental maintenance: hashes, deltas, upserts, purges, tombstones, epochs. Each takes state and returns state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of paths that are added, changed or deleted between two snapshots (path, hash)."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("changed")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("path", change.alias("change"))


def directory_hashes(files: DataFrame) -> DataFrame:
    """(dir, hash, n): for each directory with files of its own the hash over its whole subtree, whatever the order.

    A file counts once for each directory above it; only hashes are shuffled, and those of one directory meet in a list.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    each = files.select("path", "hash", parts.alias("p"), F.explode(levels).alias("k"))
    named = each.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("dir"), "path", "hash")
    own = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).distinct()
    listed = F.sort_array(F.collect_list(F.struct(F.substr("path", F.length("dir") + 2).alias("rel"), "hash")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["rel"], F.lit(":"), x["hash"])), "|")
    return named.join(own, "dir", "left_semi").groupBy("dir").agg(F.sha2(text, 256).alias("hash"), F.count("*").alias("n"))


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dir, change) between two snapshots of files; only directories of the same scanned root should be given."""
    a, b = (directory_hashes(x).select(F.col("dir").alias("path"), "hash") for x in (old, new))
    return changed_files(a, b).withColumnRenamed("path", "dir")


def properties(concepts: DataFrame) -> Column:
    """All of a concept's properties as one map of texts: its columns, and what ``extra`` holds, which wins; lists as JSON."""
    named = [f for f in concepts.schema.fields if f.name not in ("extra", "embedding")]
    values = [F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string") for f in named]
    own = F.map_from_arrays(F.array(*(F.lit(f.name) for f in named)), F.array(*values))
    if "extra" not in concepts.columns:
        return own
    more = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k)), more)


def upsert(stored: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """Fresh rows, and the stored ones whose keys aren't among theirs."""
    kept = stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def merge_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges of both, each once."""
    return stored.unionByName(fresh).distinct()


def resolve_links(raw: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw links (src, target) as (links: src, dst; broken: id, source_id, target_id); recomputed, they mend themselves."""
    known = concepts.select(F.col("id").alias("target")).distinct()
    each = raw.select("src", "target").distinct()
    broken = each.join(known, "target", "left_anti")
    named = F.concat("src", F.lit("→"), "target").alias("id")
    return each.join(known, "target").select("src", F.col("target").alias("dst")), broken.select(named, F.col("src").alias("source_id"), F.col("target").alias("target_id"))


def repaired(broken: DataFrame, concepts: DataFrame) -> DataFrame:
    """Broken links of which both ends exist by now."""
    ids = concepts.select("id")
    out = broken.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def purge(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """State without the concepts of ``gone`` (id): their chunks, edges at either end, assets that no other concept
    includes, broken links at either end, and file hashes."""
    out = dict(tables)

    def without(name: str, *cols: str) -> None:
        if name in out:
            for c in cols:
                out[name] = out[name].join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*tables[name].columns)

    without("concept", "id")
    without("chunk", "parent_doc_id")
    without("edge", "src", "dst")
    without("link_raw", "src")
    without("broken_link", "source_id", "target_id")
    without("file_hash", "concept_id")
    without("concept_posting", "id")
    without("concept_length", "id")
    for name in ("chunk_posting", "chunk_length"):
        if name in out:
            lost = tables["chunk"].join(gone.select(F.col("id").alias("parent_doc_id")), "parent_doc_id", "left_semi").select("id")
            out[name] = out[name].join(lost, "id", "left_anti").select(*tables[name].columns)
    without("includes_asset", "src")
    if "edge" in out and "chunk" in tables:
        lost = tables["chunk"].join(gone.select(F.col("id").alias("parent_doc_id")), "parent_doc_id", "left_semi")
        key = "id" if "id" in lost.columns else "chunk_id"
        out["edge"] = out["edge"].join(lost.select(F.col(key).alias("dst")), "dst", "left_anti").select(*tables["edge"].columns)
    for name in ("image_asset", "image_data"):
        if name in out and "includes_asset" in out:
            orphans = tables["includes_asset"].join(gone, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
            orphans = orphans.join(out["includes_asset"].select(F.col("dst").alias("id")), "id", "left_anti")
            out[name] = out[name].join(orphans, "id", "left_anti").select(*tables[name].columns)
    return out


def orphan_assets(assets: DataFrame, includes: DataFrame) -> DataFrame:
    """(id, uses) of assets that nothing includes."""
    used = includes.select(F.col("dst").alias("id"), F.col("src"))
    return assets.select("id").join(used, "id", "left").groupBy("id").agg(F.count("src").alias("uses")).filter("uses = 0")


def reconcile(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """(id, action) of assets (id, content_hash): reused, embedded or pruned."""
    both = stored.select("id", F.col("content_hash").alias("was")).join(planned.select("id", F.col("content_hash").alias("now")), "id", "full_outer")
    action = F.when(F.col("now").isNull(), "pruned").when(F.col("was").eqNullSafe(F.col("now")), "reused").otherwise("embedded")
    return both.select("id", action.alias("action"))


def tombstones(concepts: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Rows of deleted concepts, from which they can be had back."""
    rows = concepts.join(gone, "id", "left_semi")
    return rows.select(
        F.concat(F.lit("deleted_"), "id").alias("id"), F.col("id").alias("original_id"), "title", "body", at.alias("deleted_at"), "type", "tags"
    )


def recoverable(stones: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tombstones with age in seconds and whether they can be had back, latest first."""
    age = F.timestamp_diff("SECOND", F.col("deleted_at"), now)
    kept = F.col("deleted_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    return stones.withColumn("age_seconds", age).withColumn("recoverable", kept).orderBy(F.desc("deleted_at"), "id")


def expired(stones: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tombstones past their time; only these go, never a living concept."""
    return stones.filter(F.col("deleted_at") < now - F.make_dt_interval(hours=F.lit(hours)))


def is_dirty(meta: Mapping[str, int]) -> bool:
    """Whether something was written since the indexes were built."""
    return meta.get("write_epoch", 0) > meta.get("indexed_epoch", 0)
