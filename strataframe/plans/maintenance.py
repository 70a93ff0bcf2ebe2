"""Queries of deltas, upserts, purges, tombstones and export, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export as X
from ..operators import maintain as M
from .registry import query
from .views import Inputs, duck

_FULL = "select coalesce(o.path,n.path) path, o.hash was, n.hash now from snapshot_old o full outer join snapshot_new n on o.path=n.path"
_CHANGE = "case when was is null then 'added' when now is null then 'deleted' else 'changed' end change"


@query(duck(f"select path, {_CHANGE} from ({_FULL}) where was is distinct from now"))
def delta_files(q: Inputs) -> DataFrame:
    return M.changed_files(q.snapshot_old, q.snapshot_new)


def _dirs_sql(table: str) -> str:
    return f"""select dir, sha256(string_agg(concat(substring(path,length(dir)+2),':',hash),'|' order by substring(path,length(dir)+2))) hash, count(*) n
 from (select array_to_string(string_split(path,'/')[1:k],'/') dir, path, hash from {table}, (values (1),(2)) z(k))
 where dir in (select regexp_replace(path,'/[^/]*$','') from {table}) group by dir"""


@query(duck(_dirs_sql("snapshot_new")))
def dir_hash(q: Inputs) -> DataFrame:
    return M.directory_hashes(q.snapshot_new)


@query(duck(f"""with o as ({_dirs_sql("snapshot_old")}), n as ({_dirs_sql("snapshot_new")})
select dir, {_CHANGE} from (select coalesce(o.dir,n.dir) dir, o.hash was, n.hash now from o full outer join n on o.dir=n.dir) where was is distinct from now"""))
def delta_dirs(q: Inputs) -> DataFrame:
    return M.changed_directories(q.snapshot_old, q.snapshot_new)


@query(duck("select path, concept_id from snapshot_old where path not in (select path from snapshot_new)"))
def deleted_paths(q: Inputs) -> DataFrame:
    return q.snapshot_old.join(q.snapshot_new, "path", "left_anti").select("path", "concept_id")


@query(duck("select path, hash from snapshot_new union all select path, hash from snapshot_old where path not in (select path from snapshot_new)"))
def hash_upsert_state(q: Inputs) -> DataFrame:
    return M.upsert(q.snapshot_old, q.snapshot_new, "path").select("path", "hash")


@query(duck("""select id, title, 'new' origin from concept where doc_id%3=0 union all
 select id, concat('old ',title), 'old' from concept where doc_id%2=0 and doc_id%3<>0"""))
def upsert_state(q: Inputs) -> DataFrame:
    stored = q.concept.filter("doc_id % 2 = 0").select("id", F.concat(F.lit("old "), "title").alias("title"), F.lit("old").alias("origin"))
    fresh = q.concept.filter("doc_id % 3 = 0").select("id", "title", F.lit("new").alias("origin"))
    return M.upsert(stored, fresh, "id")


@query(duck("""select chunk_id, parent_doc_id, chunk_text from chunk where doc_id%4<>0 union all
 select concat(id,'#chunk:0'), id, title from concept where doc_id%4=0"""))
def chunk_replace_state(q: Inputs) -> DataFrame:
    fresh = q.concept.filter("doc_id % 4 = 0").select(F.concat("id", F.lit("#chunk:0")).alias("chunk_id"), F.col("id").alias("parent_doc_id"), F.col("title").alias("chunk_text"))
    return M.upsert(q.chunk.select("chunk_id", "parent_doc_id", "chunk_text"), fresh, "parent_doc_id")


@query(duck("select rel, src, dst, dst_label from edge union select 'LINKS_TO', src, dst, 'Concept' from links_to"))
def edge_merge_state(q: Inputs) -> DataFrame:
    fresh = q.links_to.select(F.lit("LINKS_TO").alias("rel"), "src", "dst", F.lit("Concept").alias("dst_label"))
    return M.merge_edges(q.edge, fresh)


def _purged(q: Inputs) -> dict[str, DataFrame]:
    gone = q.concept.filter("doc_id % 17 = 0").select("id")
    includes = q.asset_ref.select(F.col("concept_id").alias("src"), F.col("src").alias("dst"))
    assets = includes.select(F.col("dst").alias("id")).distinct()
    tables = {"concept": q.concept, "chunk": q.chunk, "edge": q.edge, "includes_asset": includes, "image_asset": assets, "broken_link": q.broken_link, "file_hash": q.snapshot_new}
    return M.purge(tables, gone)


_GONE = "(select id from concept where doc_id%17=0)"


@query(duck("select id from concept where doc_id%17<>0"))
def purge_concepts(q: Inputs) -> DataFrame:
    return _purged(q)["concept"].select("id")


@query(duck("select chunk_id from chunk where doc_id%17<>0"))
def purge_chunks(q: Inputs) -> DataFrame:
    return _purged(q)["chunk"].select("chunk_id")


@query(duck(f"select rel, src, dst from edge where src not in {_GONE} and dst not in {_GONE}"))
def purge_edges(q: Inputs) -> DataFrame:
    return _purged(q)["edge"].select("rel", "src", "dst")


@query(duck(f"""select distinct src id from asset_ref a where src in (select src from asset_ref where concept_id not in {_GONE})
 or src not in (select src from asset_ref where concept_id in {_GONE})"""))
def purge_assets(q: Inputs) -> DataFrame:
    return _purged(q)["image_asset"].select("id")


@query(duck(f"select source_id, target_id from broken_link where source_id not in {_GONE}"))
def purge_broken_links(q: Inputs) -> DataFrame:
    return _purged(q)["broken_link"].select("source_id", "target_id")


@query(duck("select id, count(src) uses from (select distinct a.src id from asset_ref a where doc_id%2=0) left join (select src, doc_id from asset_ref where doc_id%2=1) u on u.src=id group by id having count(src)=0"))
def orphan_assets(q: Inputs) -> DataFrame:
    assets = q.asset_ref.filter("doc_id % 2 = 0").select(F.col("src").alias("id")).distinct()
    includes = q.asset_ref.filter("doc_id % 2 = 1").select(F.col("concept_id").alias("src"), F.col("src").alias("dst"))
    return M.orphan_assets(assets, includes)


def _now(q: Inputs):
    return F.lit(q.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


@query(duck("select id, original_id, recoverable, date_diff('second', deleted_at, m) age from tombstone, (select max(ts) m from events)").replace("date_diff('second', deleted_at, m)", "floor(epoch(m - deleted_at))::bigint"))
def tombstones_list(q: Inputs) -> DataFrame:
    stones = M.recoverable(q.tombstone.drop("recoverable"), _now(q))
    return stones.select("id", "original_id", "recoverable", F.col("age_seconds").alias("age"))


@query(duck("select id from tombstone where not recoverable"))
def tombstones_expired(q: Inputs) -> DataFrame:
    return M.expired(q.tombstone, _now(q)).select("id")


@query(duck("select original_id id from tombstone where recoverable"))
def recovered(q: Inputs) -> DataFrame:
    return M.recoverable(q.tombstone.drop("recoverable"), _now(q)).filter("recoverable").select(F.col("original_id").alias("id"))


@query(duck("select id from concept where id like 'en/%' and len(string_split(substring(id,4),'/'))<=5 and type='chapter' and list_has_all(tags,['en','good'])"))
def export_select(q: Inputs) -> DataFrame:
    return X.select(q.concept, "en", "chapter", ("en", "good")).select("id").orderBy("id")


@query(duck("""select src id, string_agg(concat('- [',c.title,'](',dst,'.md)'), chr(10) order by c.title, dst) see_also
 from links_to join concept s on s.id=src join concept c on c.id=dst where not contains(s.body, concat(dst,'.md')) group by src"""))
def export_see_also(q: Inputs) -> DataFrame:
    return X.see_also(q.concept, q.links_to)


@query(duck("select dst id, string_agg(concat('- [',c.title,'](',src,'.md)'), chr(10) order by c.title, src) cited_by from links_to join concept c on c.id=src group by dst"))
def export_cited_by(q: Inputs) -> DataFrame:
    return X.cited_by(q.concept, q.links_to)


@query(duck("""select dir, string_agg(concat('- [',title,'](',rel,'.md)'), chr(10) order by title, rel) page from
 (select array_to_string(string_split(id,'/')[1:k],'/') dir, title, array_to_string(string_split(id,'/')[k+1:],'/') rel from concept, (values (1),(2)) z(k)) group by dir"""))
def export_index(q: Inputs) -> DataFrame:
    return X.index_pages(q.concept)
