"""Queries that go through ``Engine``: the driver's tables are put into a store once, and its operations are asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..engine import Engine
from ..functions import text as T
from ..operators import index as X
from .registry import query
from .retrieval import _FREE, DIM, FUSED_SQL, PATH_SQL, QUERY, SHORT_SQL, START_DOC, _start, bm25_sql
from .views import TABLES, Inputs, duck


#: Tables that operations read.
CONCEPTS = ("concept",)
GRAPH = ("concept", "chunk", "link_raw", "adjacency", "hub")
HYBRID = ("concept", "concept_posting", "concept_length")
CHUNKS = ("concept", "chunk", "chunk_posting", "chunk_length")


def engine_of(q: Inputs, *tables: str) -> Engine:
    """An engine over the tables as they are now; those of its store that an operation reads are put in at its first call in
    a session."""
    print_ = q.fingerprint or scratch.fingerprint(q.spark, q.folder, [f"{t}.parquet" for t in TABLES])
    engine = Engine(q.spark, f"{scratch.session_dir(q.spark)}/engine-{print_}")
    missing = {*tables} - {*engine.store.manifest()["tables"]}
    if not missing:
        return engine
    none = F.lit(None).cast("string")
    text = T.search_text(F.col("title"), F.col("description"), F.col("body"))
    concepts = q.concept.select("id", "type", "title", "description", none.alias("resource"), "tags", F.lit(None).cast("timestamp").alias("timestamp"), "body", F.lit(None).cast("map<string,string>").alias("extra"))
    place = F.lit(None).cast("long")
    chunks = q.chunk.select(F.col("chunk_id").alias("id"), "parent_doc_id", "chunk_index", "chunk_text", "block_type", place.alias("start_offset"), place.alias("end_offset"))
    state = {"link_raw": q.links_to.withColumnRenamed("dst", "target")}
    for name, rows, said in (("concept", concepts, text), ("chunk", chunks, F.col("chunk_text"))):
        state |= {name: engine._embedded(rows, said), f"{name}_posting": X.postings(X.dealt(rows, "id", said)), f"{name}_length": X.lengths(rows, "id", said)}
    state = {n: rows for n, rows in state.items() if n in missing}
    if state:
        engine.store.commit(state)
    if "adjacency" in missing:
        engine.store.commit(engine.graph_tables())
    return engine


def _near_sql(table: str, key: str, text: str, most: int) -> str:
    """The nearest by bags of hashed words, stored in single precision."""
    return f"""ct as (select {key} id, ('0x'||substr(md5(t),1,8))::bigint % {DIM} b, count(*) c
  from (select {key}, unnest(list_filter(regexp_split_to_array(lower({text}),'[^\\p{{L}}\\p{{N}}]+'), lambda y: y<>'')) t from {table}) group by all),
 qv as (select ('0x'||substr(md5(t),1,8))::bigint % {DIM} b, count(*) c from (values {",".join(f"('{t}')" for t in QUERY.split())}) z(t) group by all),
 qn as (select sqrt(sum(c*c)) n from qv), ns as (select id, sqrt(sum(c*c)) n from ct group by id),
 ds as (select ct.id, sum((ct.c/ns.n)::float::double*(qv.c/qn.n)) d from ct join ns using(id) join qv using(b), qn group by ct.id),
 v as (select x.{key} id, round(coalesce(d,0),6) sim from {table} x left join ds on ds.id=x.{key} order by sim desc, id limit {most})"""


_TEXT = "concat(title,' ',coalesce(description,''),' ',body)"


@query(duck(f"""with {bm25_sql("concept", "id", _TEXT)}, {_near_sql("concept", "id", _TEXT, 30)}, {FUSED_SQL}
select c.id, title, type, {SHORT_SQL} description, array_to_string(tags,',') tags, rrf relevance_score
from fu join concept c on c.id=fu.id where {_FREE} and list_has_any(tags,['good','fr']) order by rrf desc, c.id limit 10"""))
def engine_search_hybrid(q: Inputs) -> DataFrame:
    return engine_of(q, *HYBRID).search_hybrid(QUERY, tags=("good", "fr")).withColumn("tags", F.array_join("tags", ","))


@query(duck(f"""with {bm25_sql("chunk", "chunk_id", "chunk_text")}, {_near_sql("chunk", "chunk_id", "chunk_text", 30)}, {FUSED_SQL},
 cp as (select fu.id, c.parent_doc_id, p.title, p.type, c.chunk_text, rrf, row_number() over (partition by c.parent_doc_id order by rrf desc, fu.id) k
  from fu join chunk c on c.chunk_id=fu.id join concept p on p.id=c.parent_doc_id where p.type='note')
select id, parent_doc_id, title, type, case when length(chunk_text)>500 then concat(substring(chunk_text,1,500),'...') else chunk_text end chunk_text, rrf
from cp where k<=2 order by rrf desc, id limit 10"""))
def engine_search_chunks(q: Inputs) -> DataFrame:
    found = engine_of(q, *CHUNKS).search_chunks(QUERY, concept_type="note", max_chunks_per_doc=2)
    return found.select("id", "parent_doc_id", "title", "type", "chunk_text", "rrf")


@query(duck(f"""with s as (select src,dst from links_to),
 w as (select id, 0 d from concept where doc_id={START_DOC} union select s.dst, d+1 from w join s on s.src=w.id where d<5),
 m as (select id, min(d)::int depth from w where d>0 group by id)
select m.id, depth, title, type from m join concept c using(id) where type='chapter' and c.doc_id<>{START_DOC} order by depth, m.id limit 100""", recursive=True))
def engine_traverse_type(q: Inputs) -> DataFrame:
    return engine_of(q, *GRAPH).traverse(_start(q), "LINKS_TO", depth=5, node_type="chapter").select("id", "depth", "title", "type")


@query(duck("select c.id, title, type, array_to_string(tags,',') tags, md5(body) h from concept c where doc_id=9"))
def engine_get_by_id(q: Inputs) -> DataFrame:
    wanted = q.concept.filter("doc_id = 9").select("id").first()[0]
    found = engine_of(q, *CONCEPTS).get_by_id(wanted)
    row = [(found["id"], found["title"], found["type"], ",".join(found["tags"]), found["body"])]
    return q.spark.createDataFrame(row, "id string, title string, type string, tags string, body string").select("id", "title", "type", "tags", F.md5("body").alias("h"))


@query(PATH_SQL)
def engine_find_path(q: Inputs) -> DataFrame:
    goal = q.concept.filter("doc_id = 77").select("id").first()[0]
    path = engine_of(q, *GRAPH).find_path(_start(q), goal, 4)
    return q.spark.createDataFrame([(k, x) for k, x in enumerate(path)], "step int, id string")


@query(duck("select dst id, count(*) hub from links_to group by dst"))
def engine_hubs(q: Inputs) -> DataFrame:
    return engine_of(q, *GRAPH).hubs()


@query(duck(f"""with {bm25_sql("chunk", "chunk_id", "chunk_text")}, {_near_sql("chunk", "chunk_id", "chunk_text", 60)}, {FUSED_SQL},
 cp as (select fu.id, c.parent_doc_id, rrf, row_number() over (partition by c.parent_doc_id order by rrf desc, fu.id) k from fu join chunk c on c.chunk_id=fu.id),
 res as (select id, parent_doc_id, rrf from cp where k<=3 order by rrf desc, id limit 20),
 h as (select dst, count(*) hub from links_to group by dst), j as (select res.*, coalesce(hub,0) hub from res left join h on dst=parent_doc_id),
 b as (select *, round(0.7::double*rrf+0.3::double*hub/greatest(coalesce(max(hub) over (),1),1),8) final from j)
select id, parent_doc_id, rrf, hub, final from b order by final desc, id limit 10"""))
def engine_search_hubs(q: Inputs) -> DataFrame:
    return engine_of(q, *CHUNKS, *GRAPH).search_chunks_with_hub_score(QUERY).select("id", "parent_doc_id", "rrf", "hub", "final")


@query(duck("select count(*) n, true dirty from concept"))
def epoch_dirty(q: Inputs) -> DataFrame:
    """The store's epochs: the tables were written after the last indexing."""
    engine = engine_of(q, *CONCEPTS)
    return engine.concepts().agg(F.count("*").alias("n")).withColumn("dirty", F.lit(engine.is_dirty()))
