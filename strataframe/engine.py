"""The engine: import a folder, search it, walk it, maintain it, export it. Results are DataFrames."""

from __future__ import annotations

import datetime as dt
import functools
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import images as I
from .functions import text as T
from .functions import vectors as V
from .operators import adjacency as A
from .operators import chunks as C
from .operators import convert as Convert
from .operators import export as X
from .operators import graph as G
from .operators import index as X_
from .operators import maintain as M
from .operators import merkle as K
from .operators import quantised as Q
from .operators import rank as R
from .operators import thoughts as N
from .schemas import checked_dimension
from .scratch import bounded, materialise
from .sources import markdown as S
from .store import ADDED, Change, Store
from .workers import importable


#: Tables whose rows belong to one document.
OWNED = ("concept", "chunk", "link_raw", "includes_asset", "concept_posting", "concept_length", "chunk_posting", "chunk_length", "concept_cell", "chunk_cell")


def _operation(method):
    """An operation that reads all its tables from one state of the store."""

    @functools.wraps(method)
    def run(self, *args, **more):
        with self.store.pinned():
            return method(self, *args, **more)

    return run


def _change(method):
    """An operation that changes the store: it waits for other writers, and reads the state that it changes."""

    @functools.wraps(method)
    def run(self, *args, **more):
        with self.store.writing(), self.store.pinned():
            return method(self, *args, **more)

    return run


class Engine:
    """A store with the operations over it.

    encoder: builds an encoder on a worker (``functions.vectors.Encoder``); without one, texts are bags of hashed words.
    image_encoder: the same for images that are embedded themselves, and for texts that are looked for among them; without
    one, they are bags of hashed bytes.
    fetch: reads a remote image that the settings allow, on a worker.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), encoder: Callable[[], V.Encoder] | None = None, image_encoder: Callable[[], V.Encoder] | None = None, fetch: Callable[[str], bytes | None] | None = None):
        self.spark, self.config, self.store = importable(spark), config, Store(spark, path, config.lock_seconds)
        self._fitted: dict[str, tuple[str, Q.Quantiser | None]] = {}
        self.dimension, self._make, self.fetch = checked_dimension(config.dimension), encoder, fetch or S.fetched
        self._make_image = image_encoder or functools.partial(V.HashedBytes, self.dimension)

    # -- tables -----------------------------------------------------------------------------------------------------

    def concepts(self) -> DataFrame:
        return self.store.table("concept")

    def chunks(self) -> DataFrame:
        return self.store.table("chunk")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links, broken links), from the raw ones of today."""
        return M.resolve_links(self.store.table("link_raw"), self.concepts())

    def directories(self) -> DataFrame:
        return G.ancestry(self.concepts()).select(F.col("ancestor").alias("id")).distinct()

    def _keeps_graph(self) -> bool:
        """Whether the store has edges of its own; ``reindex`` makes them for one that hasn't."""
        tables = self.store.manifest()["tables"]
        return "adjacency" in tables or not tables.get("concept")

    def edges(self) -> DataFrame:
        """(rel, src, dst, dst_label): all relations."""
        return A.edges(self.store.table("adjacency")) if self._keeps_graph() else self.derived_edges()

    def hubs(self) -> DataFrame:
        """(id, hub): incoming links of each concept that has any."""
        if self._keeps_graph():
            return self.store.table("hub").filter("n > 0").select("id", F.col("n").alias("hub"))
        return R.hub_scores(self.derived_edges())

    def _steps(self, rels: tuple[str, ...] | None = None, direction: str = "BOTH") -> DataFrame:
        """(src, dst, dst_label): where edges lead."""
        if self._keeps_graph():
            return A.steps(self.store.table("adjacency"), rels, direction)
        return A.steps(A.change(self.derived_edges(), self.derived_edges().limit(0)), rels, direction)

    def graph_tables(self) -> dict[str, DataFrame]:
        """Edges and hub counts made anew from the other tables."""
        all_ = materialise(A.change(self.derived_edges(), self.derived_edges().limit(0)), "edges")
        return {"adjacency": all_, "hub": A.hub_change(all_)}

    def _graph_change(self, state: dict[str, Change], lost: DataFrame) -> dict[str, Change]:
        """What the changes of other tables, which replace the concepts of ``lost`` (id), change in edges and hub counts."""
        if not self._keeps_graph():
            return {}
        some = bounded(lost.select(F.col("id").alias("__lost")))
        fresh = {n: self.store.empty(n) if state[n][0] is None else state[n][0] for n in ("concept", "chunk", "includes_asset", "link_raw")}
        old = {n: self.store.table(n) for n in fresh}
        owner = {"concept": "id", "chunk": "parent_doc_id", "includes_asset": "src"}
        was = {n: old[n].join(some, F.col(k) == F.col("__lost"), "left_semi") for n, k in owner.items()}
        come, go = A.link_change(old["link_raw"], fresh["link_raw"], old["concept"], fresh["concept"], lost)
        names = ("concept", "chunk", "includes_asset")
        changed = A.change(A.owned(*(fresh[n] for n in names)).union(come), A.owned(*(was[n] for n in names)).union(go))
        changed = materialise(changed, "edges")
        return {"adjacency": (changed, ADDED), "hub": (A.hub_change(changed), ADDED)}

    def derived_edges(self) -> DataFrame:
        """(rel, src, dst, dst_label): all relations, derived from the other tables."""
        dirs = self.directories().filter(F.col("id").contains("/"))
        homes = self.concepts().filter(F.col("id").contains("/"))
        parts = [
            dirs.select(F.lit("CONTAINS"), G.parent_of(), "id", F.lit("Directory")),
            homes.select(F.lit("CONTAINS"), G.parent_of(), "id", F.lit("Concept")),
            self.links()[0].select(F.lit("LINKS_TO"), "src", "dst", F.lit("Concept")),
            self.chunks().select(F.lit("PART_OF"), "parent_doc_id", "id", F.lit("Chunk")),
            self.store.table("includes_asset").select(F.lit("INCLUDES_ASSET"), "src", "dst", F.lit("ImageAsset")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.toDF("rel", "src", "dst", "dst_label")

    # -- encoding ---------------------------------------------------------------------------------------------------

    def _embedded(self, df: DataFrame, text) -> DataFrame:
        if self._make is None:
            return df.withColumn("embedding", V.hashed(text, self.dimension).cast("array<float>"))
        return self._cut(df, V.encoder_udf(self._make, 1 << 20)(T.prefixed(text, "Document: ")))

    def _cut(self, df: DataFrame, raw: Column) -> DataFrame:
        """``df`` with embeddings of the store's dimension; higher-order functions don't take the encoder's UDF itself."""
        return df.withColumn("embedding", raw).withColumn("embedding", V.truncated(F.col("embedding"), self.dimension).cast("array<float>"))

    def _images_embedded(self, assets: DataFrame) -> DataFrame:
        """Assets (id, content_hash, embed_route, caption, data) with embeddings: those stored for the same content, or
        encoded, from their bytes if they are routed ``omni``."""
        stored = self.store.table("image_asset").filter("embedding is not null").select("id", "content_hash", F.col("embedding").alias("__kept"))
        found = materialise(assets.join(stored, ["id", "content_hash"], "left"), "assets")
        again = found.filter("__kept is not null").withColumn("embedding", F.col("__kept"))
        fresh = found.filter("__kept is null")
        texts = self._embedded(fresh.filter("embed_route <> 'omni'"), F.coalesce("caption", "alt_text", F.lit("")))
        shown = self._cut(fresh.filter("embed_route = 'omni'"), V.encoder_udf(self._make_image, 1 << 20)("data"))
        return again.unionByName(texts).unionByName(shown).drop("__kept")

    def encode_query(self, text: str, images: bool = False) -> list[float]:
        """The vector of a query, by the encoder of texts or by that of images."""
        if self._make is None and not images:
            return V.hashed_query(text, self.dimension)
        (found,) = (self._make_image if images else self._make)().encode([text if images or text.startswith("Query: ") else f"Query: {text}"])
        found = [*found[: self.dimension], *[0.0] * (self.dimension - len(found))]
        length = sum(x * x for x in found) ** 0.5
        return [x / length if length else 0.0 for x in found]

    def model_info(self) -> dict:
        """What texts and images are encoded by, and how vectors are searched."""
        made = None if self._make is None else getattr(self._make, "__qualname__", type(self._make).__qualname__)
        fitted = {grain: self._quantiser(grain) for grain in ("concept", "chunk")}
        centres = {grain: 0 if q is None else len(q.centres) for grain, q in fitted.items()}
        return {"encoder": made or "hashed words", "dimension": self.dimension, "image_mode": I.mode(self.config.image_mode), "context_limit": self.config.context_limit,
                "probes": self.config.probes, "cells": centres, "dirty": self.is_dirty()}

    # -- import -----------------------------------------------------------------------------------------------------

    def import_bundle(self, folder: str) -> list[str]:
        """Import what changed below a folder; returns the ids of this import, sorted. Deleted files are purged."""
        return sorted(r[0] for r in self.import_files(folder).collect())

    @_change
    def import_files(self, folder: str) -> DataFrame:
        """Import what changed below a folder; the ids (id) of this import. Deleted files are purged."""
        files, old = S.scan(self.spark, folder), self.store.table("file_hash")
        now = materialise(S.snapshot(files, old), "snapshot")
        changed = materialise(M.changed_files(old, now), "changed")
        if changed.isEmpty():
            return self.spark.createDataFrame([], "id string")
        # of several files of one id the least path counts, now as before
        first = lambda x: x.groupBy("concept_id").agg(F.min(F.struct("path", "hash")).alias("f"))
        moved = first(old).withColumnRenamed("f", "was").join(first(now).withColumnRenamed("f", "now"), "concept_id", "full_outer")
        moved = materialise(moved.filter(~F.col("was").eqNullSafe(F.col("now"))), "moved")
        gone = moved.filter("now is null").select(F.col("concept_id").alias("id"))
        fresh = files.join(bounded(moved.filter("now is not null").select("now.path")), "path", "left_semi")
        parsed = materialise(S.concepts(fresh), "parsed")
        failed = parsed.filter("error is not null").select(F.col("id").alias("concept_id"), "error")
        failed = materialise(moved.join(failed, "concept_id").select("now.path", "error"), "failed")
        rows = self._encoded(parsed.filter("error is null").drop("error"))
        images = S.scan(self.spark, folder, [f".{s}" for s in I.SUFFIXES])
        state = self._changes(rows, gone, images)
        # a file that can't be read is reported, keeps what it gave before, and is tried again
        paths = materialise(changed.join(bounded(failed.select("path")), "path", "left_anti").select("path"), "paths")
        state["file_hash"] = now.join(bounded(paths), "path", "left_semi"), paths
        state["import_error"] = failed, changed.select("path")
        state["dir_hash"] = self._directories(old, now, paths)
        self.store.commit(state)
        return rows.select("id")

    def _directories(self, old: DataFrame, now: DataFrame, paths: DataFrame) -> Change:
        """What changed paths change in the hashes and files of directories."""
        stored = self.store.table("dir_hash").filter("lanes is not null")
        if stored.isEmpty():  # none yet, or of an older layout
            old, paths = old.limit(0), old.select("path").union(paths).distinct()
        some = bounded(paths)
        was, is_ = (x.join(some, "path", "left_semi").select("path", F.col("hash").alias(n)) for x, n in ((old, "was"), (now, "now")))
        files = materialise(was.join(is_, "path", "full_outer"), "files")
        dirs = materialise(K.changes(stored, files), "directories")
        listed = files.groupBy(K.parent(F.col("path")).alias("path")).agg(
            F.collect_list(F.when(F.col("now").isNotNull(), F.col("path"))).alias("come"), F.collect_list(F.when(F.col("now").isNull(), F.col("path"))).alias("go")
        )  # a directory's own files
        none = F.array().cast("array<string>")
        own = dirs.join(stored.select("path", "files"), "path", "left").join(listed, "path", "left")
        kept = F.array_sort(F.array_union(F.array_except(F.coalesce("files", none), F.coalesce("go", none)), F.coalesce("come", none)))
        return own.filter("hash is not null").select("path", "hash", kept.alias("files"), "lanes", "n"), dirs.select("path")

    def import_errors(self) -> DataFrame:
        """(path, error): files that the last imports couldn't read; they are tried again at each import."""
        return self.store.table("import_error")

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """Concept rows with embeddings, made once."""
        return materialise(self._embedded(rows, T.search_text(F.col("title"), F.col("description"), F.col("body"))), "concepts")

    def _changes(self, rows: DataFrame, gone: DataFrame | None = None, files: DataFrame | None = None) -> dict[str, Change]:
        """What putting in ``rows`` (from ``_encoded``), and removing the concepts of ``gone`` (id), changes in each table."""
        text = T.search_text(F.col("title"), F.col("description"), F.col("body"))
        cut = C.overlapped(C.split(rows), self.config.chunk_overlap)
        cut = materialise(self._embedded(cut, F.col("payload")), "chunks")
        ids = rows.select("id")
        lost = materialise((ids if gone is None else ids.union(gone)).distinct(), "lost")
        fresh = {
            "concept": rows,
            "chunk": cut,
            "link_raw": S.raw_links(rows),
            "concept_posting": X_.postings(rows, "id", text),
            "concept_length": X_.lengths(rows, "id", text),
            "chunk_posting": X_.postings(cut, "id", "chunk_text"),
            "chunk_length": X_.lengths(cut, "id", "chunk_text"),
        }
        for grain, given in (("concept", rows), ("chunk", cut)):
            quantiser = self._quantiser(grain)
            if quantiser is not None:
                fresh[f"{grain}_cell"] = Q.coded(given, quantiser)
        state = {n: (df, lost) for n, df in fresh.items()} | self._images(rows, lost, files)
        return state | self._graph_change(state, lost)

    def _write(self, rows: DataFrame, files: DataFrame | None = None) -> list[str]:
        """Put in rows of the concept table that the caller gives, with images from files; their ids, sorted."""
        rows = self._encoded(rows)
        self.store.commit(self._changes(rows, None, files))
        return sorted(r[0] for r in rows.select("id").collect())

    def _removed(self, gone: DataFrame) -> dict[str, Change]:
        """What removing concepts (id) changes."""
        gone = materialise(gone.select("id").distinct(), "gone")
        paths = self.store.table("file_hash").join(bounded(gone), F.col("concept_id") == F.col("id"), "left_semi").select("path")
        state: dict[str, Change] = {n: (None, gone) for n in OWNED}
        state |= self._graph_change(state, gone)
        state["file_hash"] = None, materialise(paths, "paths")
        orphans = self._orphans(gone)
        return state | {n: (None, orphans) for n in ("image_asset", "image_data")}

    def _orphans(self, lost: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
        """(id) of assets that only concepts of ``lost`` include; fresh: (src, dst) that come in."""
        includes = self.store.table("includes_asset")
        owner = lost.withColumnRenamed("id", "src")
        was = includes.join(bounded(owner), "src", "left_semi").select("dst").distinct()
        left = includes.join(bounded(owner), "src", "left_anti").select("dst")
        left = left if fresh is None else left.union(fresh.select("dst"))
        return materialise(was.join(left, "dst", "left_anti").select(F.col("dst").alias("id")), "orphans")

    def _images(self, rows: DataFrame, lost: DataFrame, files: DataFrame | None) -> dict[str, Change]:
        refs = rows.select(F.col("id").alias("concept_id"), F.posexplode(I.references(F.col("body"))).alias("k", "r"))
        refs = refs.select("concept_id", (F.col("k") + 1).alias("number"), "r.alt", "r.src")
        none = self.spark.createDataFrame([], "path string, content binary")
        refs = S.image_bytes(refs, none if files is None else files.select("path", "content"))
        if self.config.remote_images:
            refs = S.with_remote(refs, self.config.allowed_domains, self.fetch)
        name, has = I.file_name(F.col("src")), F.col("data").isNotNull()
        how = self.config.image_mode
        known = refs.withColumns({"file_name": name, "mime_type": I.mime(F.col("data"), name), "id": I.asset_id(F.col("concept_id"), F.col("number"), F.col("src"))})
        known = known.withColumn("embed_route", I.route(how, F.col("alt"), has))
        known = known.withColumn("caption", I.caption(how, F.col("alt"), has, I.fallback_caption(F.col("file_name"), F.col("number"), F.col("concept_id"))))
        payload = F.when(F.col("embed_route") == "omni", F.col("data")).otherwise(F.col("caption").cast("binary"))
        known = known.withColumn("content_hash", I.content_hash(F.col("embed_route"), payload)).withColumn("alt_text", F.col("alt"))
        known = materialise(known.select("concept_id", "number", "id", "file_name", "mime_type", "alt_text", "caption", "embed_route", "content_hash", "data"), "images")
        includes = known.select(F.col("concept_id").alias("src"), F.col("id").alias("dst")).distinct()
        # an asset that several concepts show is as the first of them has it
        first = known.select("id", "concept_id", "number").groupBy("id").agg(F.min(F.struct("concept_id", "number")).alias("f")).select("id", "f.*")
        fresh = materialise(self._images_embedded(known.join(first, ["id", "concept_id", "number"], "left_semi")), "fresh")
        replaced = materialise(fresh.select("id").union(self._orphans(lost, includes)).distinct(), "assets")
        return {"includes_asset": (includes, lost), "image_asset": (fresh, replaced), "image_data": (fresh.select("id", "data"), replaced)}

    @_change
    def ingest_md(self, path: str, concept_id: str | None = None, title: str | None = None, description: str | None = None, tags: Sequence[str] = ()) -> str:
        """Import one file, with the images beside it; its text is linted on the way and the file itself stays as it is."""
        text = self.spark.read.text(path, wholetext=True).select(T.linted(F.col("value")).alias("t"))
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        p = text.select(S.parsed("t").alias("p")).select("p.*")
        cid = concept_id or stem.replace(" ", "_").lower()
        row = p.select(
            F.lit(cid).alias("id"),
            F.coalesce("type", F.lit("note")).alias("type"),
            F.coalesce(F.lit(title), "title", F.lit(stem.replace("_", " ").replace("-", " "))).alias("title"),
            F.coalesce(F.lit(description), "description", F.element_at("extra", "summary")).alias("description"),
            "resource",
            T.tag_union(F.col("tags"), F.array(*map(F.lit, tags))).alias("tags"),
            T.iso_timestamp(F.col("timestamp")).alias("timestamp"),
            "body",
            F.create_map().cast("map<string,string>").alias("extra"),
        )
        return self._write(row, S.scan(self.spark, path.rpartition("/")[0] or ".", [f".{s}" for s in I.SUFFIXES]))[0]

    @_change
    def ingest_thoughts(self, thoughts: str, topic: str, concept_id: str | None = None, tags: Sequence[str] = (), now: dt.datetime | None = None) -> str:
        """Keep a note; returns its id."""
        at = (now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None)
        note = self.spark.createDataFrame([(concept_id, topic, thoughts, [*tags], at)], "id string, topic string, text string, tags array<string>, at timestamp_ntz")
        return self._write(N.thoughts(note))[0]

    @_change
    def ingest_pdf(self, path: str, reader: str = "pdf_oxide:pages", routing_mode: str = "auto") -> list[str]:
        """Convert PDF or office files by a library and import their text; says which library is missing."""
        Convert.route(routing_mode, F.lit(0), F.lit(0), F.lit(0))
        files = self.spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
        texts = Convert.documents(S.read_pages(files, reader), routing_mode, self.concepts().select(F.concat("id", F.lit(".md")).alias("path")))
        rows = S.concepts(texts.select(F.col("target").alias("path"), F.encode("text", "UTF-8").alias("content")))
        return self._write(rows.filter("error is null").drop("error"))

    # -- search -----------------------------------------------------------------------------------------------------

    def _terms(self, query: str) -> list[str]:
        return [*self.spark.range(1).select(T.tokens(F.lit(query))).first()[0]]

    def _hits(self, grain: str, query: str) -> DataFrame:
        return X_.bm25(self.store.table(f"{grain}_posting"), X_.stats(self.store.table(f"{grain}_length")), self._terms(query))

    def _quantiser(self, grain: str) -> Q.Quantiser | None:
        """What ``reindex`` has fitted for a grain; read once for each state of its tables."""
        parts = self.store.manifest()["tables"]
        state = json.dumps([parts.get(n) for n in ("cell_centre", "codebook")])
        if self._fitted.get(grain, ("", None))[0] != state:
            centres, books = (self.store.table(n).filter(F.col("grain") == grain).drop("grain").collect() for n in ("cell_centre", "codebook"))  # bounded by the quantiser
            self._fitted[grain] = state, Q.Quantiser.of_rows(centres, books)
        return self._fitted[grain][1]

    def _near(self, grain: str, vector: Sequence[float], k: int) -> DataFrame:
        """The nearest of a grain: by the index that ``reindex`` has made of a large table, or of all vectors."""
        quantiser = self._quantiser(grain) if self.config.probes else None
        if quantiser is not None:
            return Q.nearest(self.store.table(f"{grain}_cell"), quantiser, vector, k, quantiser.probes(self.config.probes))
        return R.knn(self.store.table(grain), vector, k)

    @_operation
    def search_hybrid(self, query: str, concept_type: str | None = None, tags: Sequence[str] = (), parent_id: str | None = None, exclude_reserved: bool = True, limit: int = 10, include_chunks: bool = False) -> DataFrame:
        """Concepts by vectors and text, best first."""
        concepts = self.concepts()
        near = self._near("concept", self.encode_query(query), 3 * limit)
        allowed = R.concept_filter(concepts, concept_type, tags, parent_id, exclude_reserved)
        fused = R.fuse(near, self._hits("concept", query), limit, allowed)
        out = allowed.join(F.broadcast(fused), "id").select("id", "title", "type", T.shortened(F.col("description"), 200).alias("description"), "tags", F.col("rrf").alias("relevance_score"))
        if include_chunks:
            found = self._chunks_of(query, 3 * limit, 9, 3, out.select(F.col("id").alias("parent_doc_id")))
            listed = F.sort_array(F.collect_list(F.struct((-F.col("rrf")).alias("s"), "id", "chunk_text")))
            grouped = found.groupBy("parent_doc_id").agg(listed.alias("chunks"))
            out = out.join(grouped.withColumnRenamed("parent_doc_id", "id"), "id", "left")
        return out.orderBy(F.desc("relevance_score"), "id")

    def _chunks_of(self, query: str, limit: int, near: int, cap: int, parents: DataFrame | None = None, concept_type: str | None = None, tags: Sequence[str] = (), parent_id: str | None = None) -> DataFrame:
        chunks = self.chunks()
        meta = self.concepts().select(F.col("id").alias("parent_doc_id"), "title", "type", "tags")
        allowed = chunks.select("id", "parent_doc_id", "chunk_text").join(meta, "parent_doc_id", "left")
        if concept_type is not None:
            allowed = allowed.filter(F.col("type") == concept_type)
        if tags:
            allowed = allowed.filter(R.any_tag(F.col("tags"), tags))
        if parent_id is not None:
            allowed = allowed.filter(F.col("parent_doc_id") == parent_id)
        if parents is not None:
            allowed = allowed.join(F.broadcast(parents), "parent_doc_id", "left_semi")  # the results of a search
        fused = R.fuse(self._near("chunk", self.encode_query(query), near), self._hits("chunk", query), limit, allowed, "parent_doc_id", cap)
        out = allowed.join(F.broadcast(fused.select("id", "rrf")), "id").withColumn("chunk_text", T.shortened(F.col("chunk_text"), 500))
        return out.orderBy(F.desc("rrf"), "id")

    @_operation
    def search_chunks(self, query: str, concept_type: str | None = None, tags: Sequence[str] = (), parent_id: str | None = None, limit: int = 10, max_chunks_per_doc: int | None = None) -> DataFrame:
        """Chunks by vectors and text with their document's title, at most so many a document."""
        cap = self.config.max_chunks_per_doc if max_chunks_per_doc is None else max_chunks_per_doc
        return self._chunks_of(query, limit, 3 * limit, cap, None, concept_type, tags, parent_id)

    @_operation
    def search_images(self, query: str, limit: int = 10, use_text_model: bool = True) -> DataFrame:
        """Images by the encoder of texts (captions), or by that of images."""
        near = R.knn(self.store.table("image_asset"), self.encode_query(query, not use_text_model), limit)
        return self.store.table("image_asset").join(F.broadcast(near), "id").select("id", "file_name", "caption", F.col("sim").alias("score")).orderBy(F.desc("score"), "id")

    @_operation
    def search_chunks_with_hub_score(self, query: str, limit: int = 10, hub_weight: float | None = None) -> DataFrame:
        weight = self.config.hub_weight if hub_weight is None else hub_weight
        found = self.search_chunks(query, limit=2 * limit)
        return R.hub_blend(found, self.hubs(), "parent_doc_id", weight).orderBy(F.desc("final"), "id").limit(limit)

    @_operation
    def rerank_with_hub_score(self, results: DataFrame) -> DataFrame:
        return R.hub_multiply(results, self.hubs(), "parent_doc_id").orderBy(F.desc("final"), "id")

    @_operation
    def search_with_context(self, query: str, limit: int = 5) -> DataFrame:
        """(id, side, other): documents of the best chunks with links either way, directories and siblings."""
        docs = self.search_chunks(query, limit=2 * limit).limit(limit).select(F.col("parent_doc_id").alias("id")).distinct()
        above = G.ancestry(docs).select("id", F.lit("ancestor").alias("side"), F.col("ancestor").alias("other"))
        homes = F.broadcast(docs.select("id", G.parent_of().alias("home")))
        beside = self.concepts().select(F.col("id").alias("other"), G.parent_of().alias("home")).join(homes, "home").filter("other <> id")
        beside = R.capped(beside.withColumn("one", F.lit(0)), "id", 5, "one", "other").select("id", F.lit("sibling").alias("side"), "other")
        return G.neighbours(self.edges(), docs).select("id", "side", "other").union(above).union(beside)

    @_operation
    def expand_with_graph_context(self, chunk_ids: Sequence[str], hops: int = 1, max_results: int = 50) -> DataFrame:
        seeds = self.spark.createDataFrame([(c,) for c in chunk_ids], "chunk_id string")
        return G.expand(seeds, self.chunks().withColumnRenamed("id", "chunk_id"), self.edges(), self.concepts(), hops, max_results, self.hubs())

    # -- graph and documents ----------------------------------------------------------------------------------------

    @_operation
    def traverse(self, start_id: str, relationship: str = "LINKS_TO", direction: str = "OUTGOING", depth: int = 1, node_type: str | None = None, limit: int = 100) -> DataFrame:
        """The nearest ``limit`` nodes that are reached, with their depth; of a type, the nearest of that type."""
        G.checked([relationship], direction)
        found = G.walk(self._steps((relationship,), direction), start_id, relationship, depth)
        if relationship not in G.TARGET:
            found = found.join(self.concepts().select("id", "title", "type"), "id")
            found = found if node_type is None else found.filter(F.col("type") == node_type)
        return found.orderBy("depth", "id").limit(limit)

    @_operation
    def find_path(self, start_id: str, end_id: str, max_length: int = 6) -> list[str]:
        return G.find_path(self._steps(), start_id, end_id, max_length)

    def get_by_id(self, concept_id: str) -> dict | None:
        row = self.concepts().filter(F.col("id") == concept_id).drop("embedding").first()
        return None if row is None else {**{k: v for k, v in row.asDict().items() if k != "extra"}, **(row["extra"] or {})}

    @_operation
    def list_directory(self, directory: str | None = None) -> DataFrame:
        return G.list_directory(self.concepts(), self.directories(), directory)

    def ancestry(self, concept_id: str) -> list[str]:
        parts = concept_id.split("/")
        return ["/".join(parts[:k]) for k in range(1, len(parts))]

    def siblings(self, concept_id: str, limit: int = 5) -> DataFrame:
        return G.siblings(self.concepts(), concept_id, limit)

    def get_chunks(self, concept_id: str) -> DataFrame:
        return self.chunks().filter(F.col("parent_doc_id") == concept_id).drop("embedding").orderBy("chunk_index")

    def reconstruct_document(self, concept_id: str) -> str | None:
        row = C.reconstruct(self.get_chunks(concept_id)).first()
        return None if row is None else row["body"]

    def list_images(self, concept_id: str) -> DataFrame:
        mine = self.store.table("includes_asset").filter(F.col("src") == concept_id).select(F.col("dst").alias("id"))
        return self.store.table("image_asset").join(mine, "id", "left_semi").drop("embedding")

    def get_image_data(self, asset_id: str) -> bytes | None:
        row = self.store.table("image_data").filter(F.col("id") == asset_id).first()
        return None if row is None or row["data"] is None else bytes(row["data"])

    def concepts_including(self, asset_id: str) -> DataFrame:
        users = self.store.table("includes_asset").filter(F.col("dst") == asset_id).select(F.col("src").alias("id"))
        return self.concepts().join(users, "id", "left_semi").select("id", "title", "type")

    @_operation
    def preview(self, concept_id: str) -> DataFrame:
        """(label, asset, file_name, data): a concept's line with the images that it includes."""
        one = self.concepts().filter(F.col("id") == concept_id).select("id", T.preview(F.col("title"), F.col("type"), F.col("body")).alias("label"))
        used = one.join(self.store.table("includes_asset"), F.col("id") == F.col("src"), "left").select("label", F.col("dst").alias("asset"))
        named = used.join(self.store.table("image_asset").select(F.col("id").alias("asset"), "file_name"), "asset", "left")
        return named.join(self.store.table("image_data").withColumnRenamed("id", "asset"), "asset", "left").select("label", "asset", "file_name", "data")

    def table_info(self, name: str) -> list[tuple[str, str]]:
        """Columns of a stored table with their types."""
        return self.store.table(name).dtypes

    # -- maintenance ------------------------------------------------------------------------------------------------

    def list_broken_links(self) -> DataFrame:
        return self.links()[1].orderBy("id")

    def repair_links(self, before: DataFrame) -> int:
        """How many of some broken links have both ends by now; links mend themselves."""
        return M.repaired(before, self.concepts()).count()

    @_change
    def purge(self, concept_id: str) -> bool:
        gone = self.spark.createDataFrame([(concept_id,)], "id string")
        if self.concepts().filter(F.col("id") == concept_id).isEmpty():
            return False
        self.store.commit(self._removed(gone))
        return True

    @_change
    def soft_delete(self, concept_id: str, at: dt.datetime | None = None) -> bool:
        gone = self.spark.createDataFrame([(concept_id,)], "id string")
        stone = M.tombstones(self.concepts(), gone, F.lit(at or dt.datetime.now(dt.timezone.utc)).cast("timestamp"))
        if stone.isEmpty():
            return False
        self.store.commit(self._removed(gone) | {"deleted_concept": (stone, stone.select("id"))})
        return True

    def list_deleted(self, now: dt.datetime | None = None) -> DataFrame:
        at = F.lit(now or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
        return M.recoverable(self.store.table("deleted_concept"), at, self.config.recover_hours)

    @_change
    def recover(self, deleted_id: str) -> str | None:
        """Bring a deleted concept back: its title, body, type and tags; one commit."""
        stones = self.store.table("deleted_concept")
        row = stones.filter((F.col("id") == deleted_id) | (F.col("original_id") == deleted_id))
        found = row.select("id", "original_id").first()
        if found is None:
            return None
        back = row.select(F.col("original_id").alias("id"), "type", "title", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("resource"), "tags", F.col("deleted_at").alias("timestamp"), "body", F.create_map().cast("map<string,string>").alias("extra"))
        stone = self.spark.createDataFrame([(found["id"],)], "id string")
        self.store.commit(self._changes(self._encoded(back)) | {"deleted_concept": (None, stone)})
        return found["original_id"]

    @_change
    def purge_expired(self, now: dt.datetime | None = None) -> int:
        at = F.lit(now or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
        stones = self.store.table("deleted_concept")
        old = M.expired(stones, at, self.config.recover_hours)
        n = old.count()
        if n:
            self.store.commit({"deleted_concept": (None, materialise(old.select("id"), "expired"))})
        return n

    def is_dirty(self) -> bool:
        return M.is_dirty(self.store.manifest()["meta"])

    @_change
    def reindex(self, force: bool = False) -> bool:
        """Build postings, lengths, edges and, for large tables, the vector index anew, if something was written since or ``force``."""
        meta = self.store.manifest()["meta"]
        if not force and not M.is_dirty(meta):
            return False
        texts = {"concept": T.search_text(F.col("title"), F.col("description"), F.col("body")), "chunk": F.col("chunk_text")}
        state, centres, books = {}, [], []
        for grain, text in texts.items():
            rows = self.store.table(grain)
            state[f"{grain}_posting"], state[f"{grain}_length"] = X_.postings(X_.dealt(rows, "id", text)), X_.lengths(rows, "id", text)
            found = None if rows.limit(Q.LEAST_ROWS).count() < Q.LEAST_ROWS else Q.fit(rows)
            state[f"{grain}_cell"] = self.store.empty(f"{grain}_cell") if found is None else Q.coded(rows, found)
            if found is not None:
                cells, entries = found.rows()
                centres += [(grain, *c) for c in cells]
                books += [(grain, *e) for e in entries]
        for name, given in (("cell_centre", centres), ("codebook", books)):
            state[name] = self.spark.createDataFrame(given, self.store.empty(name).schema)
        self.store.commit(state | self.graph_tables(), {"write_epoch": meta["write_epoch"], "indexed_epoch": meta["write_epoch"]})
        return True

    # -- export -----------------------------------------------------------------------------------------------------

    def export_bundle(self, folder: str, parent_id: str | None = None, concept_type: str | None = None, tags: Sequence[str] = ()) -> list[str]:
        """Write Markdown files and an index of each directory; returns the ids, sorted."""
        return sorted(r[0] for r in self.export_files(folder, parent_id, concept_type, tags).collect())

    @_operation
    def export_files(self, folder: str, parent_id: str | None = None, concept_type: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
        """Write Markdown files and an index of each directory; the ids (id) of what was written."""
        chosen = X.select(self.concepts(), parent_id, concept_type, tags)
        X.write_files(X.documents(chosen.drop("embedding"), self.links()[0]), folder)
        pages = X.index_pages(chosen)
        X.write_files(pages.select(F.concat("dir", F.lit("/index")).alias("id"), F.concat(F.lit("# "), "dir", F.lit("\n\n"), "page", F.lit("\n")).alias("text")), folder)
        return chosen.select("id")
