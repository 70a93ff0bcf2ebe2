"""Queries of search, chunks and the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunks as C
from ..operators import graph as G
from ..operators import impact as L
from ..operators import rank as R
from ..operators import index as X
from ..operators import quantised as C_
from .registry import query
from .stored import DIM, quantiser, stored
from .views import Inputs, duck

TERMS = ("the", "thou", "oren")
LIMIT = 10
START_DOC = 5


def bm25_sql(table: str, key: str, text: str) -> str:
    values = ",".join(f"('{t}')" for t in TERMS)
    return f"""x as (select {key} id, list_filter(regexp_split_to_array(lower({text}),'[^\\p{{L}}\\p{{N}}]+'), lambda y: y<>'') tk from {table}),
 st as (select count(*) n, avg(len(tk)) av from x),
 tf as (select id, len(tk) dl, t, len(list_filter(tk, lambda y: y=t)) tf from x, (values {values}) q(t)),
 tp as (select * from tf where tf>0), df as (select t, count(*) df from tp group by t),
 sc as (select id, round(sum(ln((n-df+0.5::double)/(df+0.5::double)+1)*tf*2.2::double/(tf+1.2::double*(0.25::double+0.75::double*dl/av))),6) score
  from tp join df using(t), st group by id)"""


NEAR_SQL = """v as (select vec_id id, round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id=0)),6) sim
 from embeddings order by sim desc, id limit 30)"""
FUSED_SQL = """vr as (select *, row_number() over (order by sim desc, id) vr from v), fr as (select *, row_number() over (order by score desc, id) fr from sc),
 fu as (select coalesce(vr.id,fr.id) id, round(coalesce(1::double/(60+vr),0)+coalesce(1::double/(60+fr),0),8) rrf from vr full outer join fr on vr.id=fr.id)"""
SHORT_SQL = "case when length(description)>200 then concat(substring(description,1,200),'...') else description end"


def near_documents(q: Inputs, k: int = 3 * LIMIT) -> DataFrame:
    vectors = stored(q, "vector")
    vector = vectors.filter("vec_id = 0").select("embedding").first()[0]
    return R.knn(vectors, vector, k, "vec_id")


def _document_hits(q: Inputs) -> DataFrame:
    return X.bm25(stored(q, "document_posting"), stored(q, "document_stats"), TERMS)


def _hybrid(q: Inputs, **filters) -> DataFrame:
    allowed = R.concept_filter(stored(q, "concept_meta"), **filters)
    keyed = allowed.select(F.col("doc_id").alias("id"))
    fused = R.fuse(near_documents(q), _document_hits(q), LIMIT, keyed)
    found = allowed.join(F.broadcast(fused.withColumnRenamed("id", "doc_id")), "doc_id")  # LIMIT rows
    return found.select("id", "title", "type", T.shortened(F.col("description"), 200).alias("description"), F.array_join("tags", ",").alias("tags"), F.col("rrf").alias("relevance_score"))


def _hybrid_sql(where: str) -> str:
    return duck(f"""with {bm25_sql("documents", "doc_id", "text")}, {NEAR_SQL}, {FUSED_SQL}
select c.id, title, type, {SHORT_SQL} description, array_to_string(tags,',') tags, rrf relevance_score
from fu join concept c on c.doc_id=fu.id where {where} order by rrf desc, doc_id limit {LIMIT}""")


_FREE = "not (c.id like '%index' or c.id like '%log')"


@query(_hybrid_sql(_FREE))
def hybrid_search(q: Inputs) -> DataFrame:
    return _hybrid(q)


@query(_hybrid_sql(f"{_FREE} and type='note'"))
def hybrid_search_type(q: Inputs) -> DataFrame:
    return _hybrid(q, type_="note")


@query(_hybrid_sql(f"{_FREE} and list_has_any(tags,['good','fr'])"))
def hybrid_search_tags_any(q: Inputs) -> DataFrame:
    return _hybrid(q, tags=("good", "fr"))


@query(_hybrid_sql(f"{_FREE} and c.id like 'en/%' and len(string_split(substring(c.id,4),'/'))<=3"))
def hybrid_search_parent3(q: Inputs) -> DataFrame:
    return _hybrid(q, parent="en")


@query(_hybrid_sql("true"))
def hybrid_search_reserved(q: Inputs) -> DataFrame:
    return _hybrid(q, exclude_reserved=False)


@query(duck("with " + bm25_sql("concept", "doc_id", "concat(title,' ',coalesce(description,''),' ',body)") + " select id doc_id, score from sc"))
def fts_bm25_concept(q: Inputs) -> DataFrame:
    return X.bm25(stored(q, "concept_posting"), stored(q, "concept_stats"), TERMS).withColumnRenamed("id", "doc_id")


@query(duck("with " + bm25_sql("chunk", "chunk_id", "chunk_text") + " select id chunk_id, score from sc"))
def fts_bm25_chunk(q: Inputs) -> DataFrame:
    return R.bm25(q.chunk, TERMS, "chunk_id", "chunk_text").withColumnRenamed("id", "chunk_id")


def _best_hits(q: Inputs, grain: str) -> DataFrame:
    return L.top(stored(q, f"{grain}_impact"), stored(q, f"{grain}_level"), stored(q, f"{grain}_stats"), TERMS, LIMIT)


@query("with " + bm25_sql("documents", "doc_id", "text") + f" select id doc_id, score from sc order by score desc, id limit {LIMIT}")
def fts_top_documents(q: Inputs) -> DataFrame:
    return _best_hits(q, "document").withColumnRenamed("id", "doc_id")


@query(duck("with " + bm25_sql("chunk", "chunk_id", "chunk_text") + f" select id chunk_id, score from sc order by score desc, id limit {LIMIT}"))
def fts_top_chunks(q: Inputs) -> DataFrame:
    return _best_hits(q, "chunk").withColumnRenamed("id", "chunk_id")


@query("with " + bm25_sql("documents", "doc_id", "text") + " select id doc_id, score from sc")
def fts_bm25_postings(q: Inputs) -> DataFrame:
    return X.bm25(X.postings(q.documents, "doc_id"), X.stats(X.lengths(q.documents, "doc_id")), TERMS).withColumnRenamed("id", "doc_id")


@query(f"with {NEAR_SQL} select id vec_id, sim from v")
def vector_topk(q: Inputs) -> DataFrame:
    return near_documents(q).withColumnRenamed("id", "vec_id")


@query(f"with {NEAR_SQL} select id vec_id, sim from v order by sim desc, id limit 10")
def vector_topk_compressed(q: Inputs) -> DataFrame:
    """Through the codes of all cells, as these vectors have no clusters; whatever may be among the nearest is ranked exactly."""
    vector, fitted = stored(q, "vector").filter("vec_id = 0").select("embedding").first()[0], quantiser(q)
    return C_.exact_nearest(stored(q, "vector_cell"), fitted, vector, LIMIT).withColumnRenamed("id", "vec_id")


@query(f"with {NEAR_SQL} select concat('img_',id) asset_id, sim score from v order by sim desc, id limit 10")
def image_topk(q: Inputs) -> DataFrame:
    return near_documents(q, LIMIT).select(F.concat(F.lit("img_"), "id").alias("asset_id"), F.col("sim").alias("score"))


QUERY = " ".join(TERMS)
_SIM_SQL = f"""ct as (select chunk_id, ('0x'||substr(md5(t),1,8))::bigint % {DIM} b, count(*) c
  from (select chunk_id, unnest(list_filter(regexp_split_to_array(lower(chunk_text),'[^\\p{{L}}\\p{{N}}]+'), lambda y: y<>'')) t from chunk) group by all),
 qv as (select ('0x'||substr(md5(t),1,8))::bigint % {DIM} b, count(*) c from (values ('the'),('thou'),('oren')) z(t) group by all),
 qn as (select sqrt(sum(c*c)) n from qv),
 ds as (select chunk_id, sum(ct.c*qv.c)/any_value(n) d from ct join qv using(b), qn group by chunk_id),
 ns as (select chunk_id, sqrt(sum(c*c)) n from ct group by chunk_id),
 v as (select chunk_id id, round(coalesce(d/n,0),6) sim from chunk left join ns using(chunk_id) left join ds using(chunk_id) order by sim desc, id limit 30)"""


def _chunk_near(q: Inputs) -> DataFrame:
    return X.knn_wide(stored(q, "chunk_vector"), V.hashed_query(QUERY, DIM), 3 * LIMIT)


def _chunk_hits(q: Inputs) -> DataFrame:
    return X.bm25(stored(q, "chunk_posting"), stored(q, "chunk_stats"), TERMS)


def _chunk_search(q: Inputs, limit: int = LIMIT, cap: int = 3, parent: str | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    chunks = stored(q, "chunk")
    if parent is not None:
        chunks = chunks.filter(F.col("parent_doc_id") == parent)
    if tags:
        chunks = chunks.filter(R.any_tag(F.col("tags"), tags))
    fused = R.fuse(_chunk_near(q), _chunk_hits(q), limit, chunks, "parent_doc_id", cap)
    found = chunks.join(F.broadcast(fused.select("id", "rrf")), "id")
    return found.select(F.col("id").alias("chunk_id"), "parent_doc_id", "title", "type", T.shortened(F.col("chunk_text"), 500).alias("chunk_text"), "rrf")


def _chunk_sql(where: str = "true", cap: int = 3, limit: int = LIMIT, tail: str = "") -> str:
    return duck(f"""with {bm25_sql("chunk", "chunk_id", "chunk_text")}, {_SIM_SQL}, {FUSED_SQL},
 cp as (select fu.id chunk_id, c.parent_doc_id, p.title, p.type, p.tags, c.chunk_text, rrf,
  row_number() over (partition by c.parent_doc_id order by rrf desc, fu.id) k
  from fu join chunk c on c.chunk_id=fu.id left join concept p on p.id=c.parent_doc_id where {where}),
 res as (select chunk_id, parent_doc_id, title, type, case when length(chunk_text)>500 then concat(substring(chunk_text,1,500),'...') else chunk_text end chunk_text, rrf
  from cp where k<={cap} order by rrf desc, chunk_id limit {limit})
{tail or "select * from res"}""")


@query(_chunk_sql())
def chunk_search(q: Inputs) -> DataFrame:
    return _chunk_search(q)


@query(_chunk_sql(cap=1))
def chunk_search_cap1(q: Inputs) -> DataFrame:
    return _chunk_search(q, cap=1)


@query(_chunk_sql("list_has_any(p.tags,['fr'])"))
def chunk_search_tags(q: Inputs) -> DataFrame:
    return _chunk_search(q, tags=("fr",))


PARENT_ID = "en/src1/doc_1"


@query(_chunk_sql(f"c.parent_doc_id='{PARENT_ID}'"))
def chunk_search_parent(q: Inputs) -> DataFrame:
    return _chunk_search(q, parent=PARENT_ID)


_HUB = "hub as (select dst, count(*) hub from edge where rel='LINKS_TO' group by dst)"


@query(_chunk_sql(limit=2 * LIMIT, tail=f""", {_HUB}, j as (select res.*, coalesce(hub,0) hub from res left join hub on dst=parent_doc_id),
 b as (select *, round(0.7::double*rrf+0.3::double*hub/greatest(coalesce(max(hub) over (),1),1),8) final from j)
select * from b order by final desc, chunk_id limit {LIMIT}"""))
def chunk_hub_blend(q: Inputs) -> DataFrame:
    found = R.hub_blend(_chunk_search(q, 2 * LIMIT), R.hub_scores(stored(q, "edge")), "parent_doc_id")
    return found.orderBy(F.desc("final"), "chunk_id").limit(LIMIT)


@query(_chunk_sql(tail=f""", {_HUB}
select res.*, coalesce(hub,0) hub, round(rrf*(1+0.1::double*coalesce(hub,0)),8) final from res left join hub on dst=parent_doc_id"""))
def chunk_hub_multiply(q: Inputs) -> DataFrame:
    return R.hub_multiply(_chunk_search(q), R.hub_scores(stored(q, "edge")), "parent_doc_id")


@query(duck(f"""with {bm25_sql("documents", "doc_id", "text")}, {NEAR_SQL}, {FUSED_SQL},
 top as (select c.id parent_doc_id, rrf from fu join concept c on c.doc_id=fu.id where {_FREE} order by rrf desc, doc_id limit {LIMIT}),
 {bm25_sql("chunk", "chunk_id", "chunk_text").replace("x as", "cx as", 1).replace("from x", "from cx").replace(" st as", " cst as").replace(" tf as", " ctf as").replace("from tf", "from ctf").replace(" tp as", " ctp as").replace("from tp", "from ctp").replace(" df as", " cdf as").replace("join df", "join cdf").replace(", st group", ", cst group").replace(" sc as", " csc as")},
 {_SIM_SQL.replace(" v as", " cv as")},
 cvr as (select *, row_number() over (order by sim desc, id) vr from (select * from cv order by sim desc, id limit 9)),
 cfr as (select *, row_number() over (order by score desc, id) fr from csc),
 cfu as (select coalesce(cvr.id,cfr.id) id, round(coalesce(1::double/(60+vr),0)+coalesce(1::double/(60+fr),0),8) crrf from cvr full outer join cfr on cvr.id=cfr.id),
 k as (select top.*, cfu.id chunk_id, crrf, row_number() over (partition by c.parent_doc_id order by crrf desc, cfu.id) k from cfu join chunk c on c.chunk_id=cfu.id join top using(parent_doc_id))
select parent_doc_id, rrf, chunk_id, crrf from k where k<=3"""))
def hybrid_search_with_chunks(q: Inputs) -> DataFrame:
    allowed = R.concept_filter(stored(q, "concept_meta"))
    fused = R.fuse(near_documents(q), _document_hits(q), LIMIT, allowed.select(F.col("doc_id").alias("id")))
    top = allowed.join(F.broadcast(fused.withColumnRenamed("id", "doc_id")), "doc_id").select(F.col("id").alias("parent_doc_id"), "rrf")
    chunks = stored(q, "chunk").select("id", "parent_doc_id").join(F.broadcast(top.select("parent_doc_id")), "parent_doc_id", "left_semi")
    near = _chunk_near(q).orderBy(F.desc("sim"), "id").limit(9)
    ranked = R.fuse(near, _chunk_hits(q), 3 * LIMIT, chunks, "parent_doc_id", 3)
    return ranked.select(F.col("id").alias("chunk_id"), "parent_doc_id", F.col("rrf").alias("crrf")).join(top, "parent_doc_id").select("parent_doc_id", "rrf", "chunk_id", "crrf")


_EXPAND = """lk as (select src,dst from edge where rel='LINKS_TO'), sd as (select distinct parent_doc_id id from chunk where chunk_id in ({ids})),
 t as (select distinct dst id from lk join sd on src=id), h as (select dst id, count(*) hub from lk group by dst)
select t.id, title, substring(coalesce(description,''),1,200) description, hub from t join concept using(id) join h using(id) order by hub desc, id limit 50"""
SEEDS = ("en/src1/doc_1#chunk:0", "en/src2/doc_2#chunk:0", "fr/src4/doc_4#chunk:0")


@query(duck("with " + _EXPAND.format(ids=",".join(f"'{s}'" for s in SEEDS))))
def graph_expand(q: Inputs) -> DataFrame:
    seeds = q.spark.createDataFrame([(s,) for s in SEEDS], "chunk_id string")
    return G.expand(F.broadcast(seeds), stored(q, "chunk").withColumnRenamed("id", "chunk_id"), stored(q, "edge"), stored(q, "concept_meta"))


@query(_chunk_sql(limit=5, tail=""", d as (select distinct parent_doc_id id from res), lk as (select src,dst from edge where rel='LINKS_TO'),
 s as (select dst id, 'incoming' side, src other from lk union all select src, 'outgoing', dst from lk
  union all select id, 'ancestor', array_to_string(string_split(id,'/')[1:k],'/') from d, (values (1),(2)) z(k)
  union all select d.id, 'sibling', c.id from d join concept c on regexp_replace(c.id,'/[^/]*$','')=regexp_replace(d.id,'/[^/]*$','') and c.id<>d.id),
 r as (select s.*, row_number() over (partition by id, side order by other) k from s join d using(id))
select id, side, other from r where k<=5"""))
def search_context_flat(q: Inputs) -> DataFrame:
    docs = _chunk_search(q, 5).select(F.col("parent_doc_id").alias("id")).distinct()
    linked = G.neighbours(stored(q, "edge"), docs)
    above = G.ancestry(docs).select("id", F.lit("ancestor").alias("side"), F.col("ancestor").alias("other"))
    homes = F.broadcast(docs.select("id", G.parent_of().alias("home")))
    beside = stored(q, "concept_meta").select(F.col("id").alias("other"), G.parent_of().alias("home")).join(homes, "home").filter("other <> id")
    beside = R.capped(beside.withColumn("one", F.lit(0)), "id", 5, "one", "other").select("id", F.lit("sibling").alias("side"), "other")
    return linked.select("id", "side", "other").union(above).union(beside)


@query(f"""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text),'[^\\p{{L}}\\p{{N}}]+'), lambda y: y<>'')) t from documents),
 c as (select doc_id, ('0x'||substr(md5(t),1,8))::bigint % {DIM} k, count(*) c from t group by all)
select doc_id, k, round(c/sqrt(sum(c*c) over (partition by doc_id)),6) x from c""")
def encode_hash(q: Inputs) -> DataFrame:
    encoded = q.documents.select("doc_id", V.hashed(F.col("text"), DIM).alias("v"))
    return encoded.select("doc_id", F.posexplode("v").alias("k", "x")).filter("x > 0").select("doc_id", F.col("k").cast("bigint").alias("k"), F.round("x", 6).alias("x"))


@query("""with v as (select vec_id, embedding[1:32]::double[] e from embeddings), n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x*x))) n from v)
select vec_id, generate_subscripts(e,1)-1 k, round(unnest(e)/n,6) x from n""")
def matryoshka_truncate(q: Inputs) -> DataFrame:
    cut = q.embeddings.select("vec_id", F.posexplode(V.truncated(F.col("embedding"), 32)).alias("k", "x"))
    return cut.select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("x", 6).alias("x"))


@query("select doc_id, md5(case when text like 'Document: %' then text else concat('Document: ',text) end) h from documents")
def encode_prefix(q: Inputs) -> DataFrame:
    return q.documents.select("doc_id", F.md5(T.prefixed(F.col("text"), "Document: ")).alias("h"))


#: A document as Markdown: its blocks, as (kind, SQL of their text), which is the same in both dialects.
_BLOCKS = (
    ("Heading", "concat('# Doc ',doc_id)"),
    ("Paragraph", "concat('P ',{flat})"),
    ("List", "concat('- é',doc_id,'{n}- b')"),
    ("Blockquote", "concat('> ',lang,'{n}> more')"),
    ("Heading", "'## Ünder'"),
    ("Table", "concat('| x |{n}|---|{n}| ',doc_id,' |')"),
    ("CodeBlock", "concat('```py{n}code{n}{n}# no heading ',doc_id,'{n}```')"),
    ("Diagram", "concat('```mermaid{n}g',doc_id,'{n}```')"),
    ("Paragraph", "concat('end{n}line ',source)"),
)
_DUCK_BLOCKS = [(k, x.format(flat="regexp_replace(text,'[^!-~À-ɏ]+',' ','g')", n="\n").replace("\n", "'||chr(10)||'")) for k, x in _BLOCKS]


@query(f"""with b as (select doc_id, unnest([{",".join(x for _, x in _DUCK_BLOCKS)}]) t, unnest([{",".join(f"'{k}'" for k, _ in _BLOCKS)}]) kind, unnest(range({len(_BLOCKS)})) k from documents),
 o as (select *, coalesce(sum(strlen(t)+2) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding),0)::bigint a from b)
select concat(doc_id,'#chunk:',k) id, k::bigint chunk_index, kind block_type, md5(t) h, a start_offset, (a+strlen(t))::bigint end_offset from o""")
def chunk_split(q: Inputs) -> DataFrame:
    texts = [x.format(flat="regexp_replace(text,'[^!-~À-ɏ]+',' ')", n="\\n") for _, x in _BLOCKS]
    bodies = q.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("\n\n", *map(F.expr, texts)).alias("body"))
    return C.split(bodies).select("id", "chunk_index", "block_type", F.md5("chunk_text").alias("h"), "start_offset", "end_offset")


_STRUCT = "('Heading','CodeBlock','List','Blockquote','Table','Diagram')"


@query(duck(f"""with w as (select *, last_value(case when block_type='Heading' then chunk_text end ignore nulls) over (partition by parent_doc_id order by chunk_index rows between unbounded preceding and 1 preceding) heading,
  lag(chunk_text) over (partition by parent_doc_id order by chunk_index) bt, lag(block_type) over (partition by parent_doc_id order by chunk_index) bk from chunk),
 t as (select *, case when block_type not in {_STRUCT} and bk not in {_STRUCT} then
  array_to_string(list_filter(regexp_split_to_array(trim(bt,' '),'\\s+'), lambda y: y<>'')[-5:],'  ') end tail from w)
select chunk_id, heading, tail, md5(concat_ws(chr(10)||chr(10), case when block_type<>'Heading' then heading end, case when tail<>'' then tail end, chunk_text)) h from t"""))
def overlap_payload(q: Inputs) -> DataFrame:
    return C.overlapped(q.chunk).select("chunk_id", "heading", "tail", F.md5("payload").alias("h"))


@query(duck("select id parent_doc_id, md5(body) h from concept"))
def reconstruct(q: Inputs) -> DataFrame:
    return C.reconstruct(q.chunk, "\n").select("parent_doc_id", F.md5("body").alias("h"))


@query(duck("""select parent_doc_id, md5(string_agg(concat(case when lg is null then '' when lg=block_type and block_type in ('List','Table') then chr(10) else chr(10)||chr(10) end, chunk_text), '' order by chunk_index)) h
 from (select *, lag(block_type) over (partition by parent_doc_id order by chunk_index) lg from chunk) group by 1"""))
def block_delimiters(q: Inputs) -> DataFrame:
    return C.reconstruct(q.chunk).select("parent_doc_id", F.md5("body").alias("h"))


@query(duck(f"select chunk_id, chunk_index, block_type, chunk_text from chunk where parent_doc_id='{PARENT_ID}'"))
def chunks_of_doc(q: Inputs) -> DataFrame:
    mine = q.chunk.filter(F.col("parent_doc_id") == PARENT_ID)
    return mine.select("chunk_id", "chunk_index", "block_type", "chunk_text").orderBy("chunk_index")


@query(duck("""select chunk_id, len(list_filter(regexp_split_to_array(lower(chunk_text),'[^\\p{L}\\p{N}]+'), lambda y: y<>''))::int n_words from chunk
 where len(list_filter(regexp_split_to_array(lower(chunk_text),'[^\\p{L}\\p{N}]+'), lambda y: y<>''))*10 >= 200*9"""))
def context_window_warn(q: Inputs) -> DataFrame:
    return C.over_context(q.chunk, 200).select("chunk_id", "n_words")


def _start(q: Inputs) -> str:
    return stored(q, "concept_meta").filter(F.col("doc_id") == START_DOC).select("id").first()[0]


def _walk_sql(rel: str, start: str, depth: int, both: str = "out", label: str = "Concept") -> str:
    steps = {
        "out": f"select src,dst,dst_label from edge where rel='{rel}'",
        "in": f"select dst src,src dst, case when src like '%doc_%' then 'Concept' else 'Directory' end dst_label from edge where rel='{rel}'",
    }
    s = steps["out"] + " union all " + steps["in"] if both == "both" else steps[both]
    return duck(f"""with s as ({s}), w as (select {start} id, ''::varchar lb, 0 d union select s.dst, s.dst_label, d+1 from w join s on s.src=w.id where d<{depth})
select id, min(d)::int depth from w where lb='{label}' and id<>{start} group by id""", recursive=True)


_START_SQL = f"(select id from concept where doc_id={START_DOC})"


@query(_walk_sql("CONTAINS", "'en'", 2))
def traverse_contains_out(q: Inputs) -> DataFrame:
    return G.traverse(stored(q, "edge"), "en", "CONTAINS", "OUTGOING", 2)


@query(_walk_sql("CONTAINS", _START_SQL, 3, "in", "Directory"))
def traverse_contains_in(q: Inputs) -> DataFrame:
    return G.traverse(stored(q, "edge"), _start(q), "CONTAINS", "INCOMING", 3, any_target=True)


@query(_walk_sql("CONTAINS", _START_SQL, 2, "both"))
def traverse_contains_both(q: Inputs) -> DataFrame:
    return G.traverse(stored(q, "edge"), _start(q), "CONTAINS", "BOTH", 2)


@query(_walk_sql("LINKS_TO", _START_SQL, 3))
def traverse_links_depth3(q: Inputs) -> DataFrame:
    return G.traverse(stored(q, "edge"), _start(q), "LINKS_TO", "OUTGOING", 3)


@query(_walk_sql("PART_OF", _START_SQL, 1, label="Chunk"))
def traverse_part_of(q: Inputs) -> DataFrame:
    return G.traverse(stored(q, "edge"), _start(q), "PART_OF")


@query(duck("select distinct concat('asset_',doc_id,'_',idx) id, 1 depth from asset_ref where doc_id=5"))
def traverse_assets(q: Inputs) -> DataFrame:
    asset = F.concat(F.lit("asset_"), "doc_id", F.lit("_"), "idx")
    edges = q.asset_ref.select(F.lit("INCLUDES_ASSET").alias("rel"), F.col("concept_id").alias("src"), asset.alias("dst"), F.lit("ImageAsset").alias("dst_label"))
    return G.traverse(edges, _start(q), "INCLUDES_ASSET")


@query(duck(f"""with s as (select src,dst from edge union all select dst,src from edge),
 w as (select id, 0 d from concept where doc_id={START_DOC} union select s.dst, d+1 from w join s on s.src=w.id where d<3)
select id, min(d)::int d from w group by id""", recursive=True))
def shortest_path_len(q: Inputs) -> DataFrame:
    levels = G.distances(stored(q, "steps"), _start(q), most=3)
    out = None
    for k, level in enumerate(levels):
        rows = level.select("id", F.lit(k).alias("d"))
        out = rows if out is None else out.union(rows)
    return out


PATH_SQL = duck(f"""with s as (select distinct src,dst from (select src,dst from edge union all select dst,src from edge)),
 a as (select id from concept where doc_id={START_DOC}), b as (select id from concept where doc_id=77),
 w as (select id, 0 d from a union select s.dst, d+1 from w join s on s.src=w.id where d<4),
 m as (select id, min(d) d from w group by id),
 p as (select m.id, m.d from m join b using(id) union all select (select min(s.src) from s join m on m.id=s.src where s.dst=p.id and m.d=p.d-1), p.d-1 from p where p.d>0)
select d::int step, id from p""", recursive=True)


@query(PATH_SQL)
def shortest_path_nodes(q: Inputs) -> DataFrame:
    goal = q.concept.filter("doc_id = 77").select("id").first()[0]
    path = G.find_path(stored(q, "steps"), _start(q), goal, 4)
    return q.spark.createDataFrame([(k, x) for k, x in enumerate(path)], "step int, id string")


@query(duck("select id, k::int depth, array_to_string(string_split(id,'/')[1:k],'/') ancestor from concept, (values (1),(2)) z(k)"))
def ancestry(q: Inputs) -> DataFrame:
    return G.ancestry(q.concept)


@query(duck("select id, regexp_replace(id,'/[^/]*$','') ancestor from concept"))
def ancestry_nearest(q: Inputs) -> DataFrame:
    return G.ancestry(q.concept, nearest_only=True).select("id", "ancestor")


@query(duck(f"""select id, title from concept where regexp_replace(id,'/[^/]*$','')=(select regexp_replace(id,'/[^/]*$','') from concept where doc_id={START_DOC})
 and doc_id<>{START_DOC} order by id limit 5"""))
def siblings(q: Inputs) -> DataFrame:
    return G.siblings(q.concept, _start(q))


@query(duck("select 0 ordinal, id, 'Directory' type from directory where id not like '%/%' union all select 1, id, type from concept where id not like '%/%'"))
def list_root(q: Inputs) -> DataFrame:
    return G.list_directory(q.concept, q.directory)


@query(duck("""select 0 ordinal, id, 'Directory' type from directory where id like '%/%' and regexp_replace(id,'/[^/]*$','')='en/src1'
 union all select 1, id, type from concept where regexp_replace(id,'/[^/]*$','')='en/src1'"""))
def list_dir(q: Inputs) -> DataFrame:
    return G.list_directory(q.concept, q.directory, "en/src1")


@query(duck("select id from concept where id like 'fr/%' and len(string_split(substring(id,4),'/'))<=5"))
def under_directory5(q: Inputs) -> DataFrame:
    return q.concept.filter(R.below(F.col("id"), "fr", 5)).select("id")


@query(duck("select dst id, count(*) hub from edge where rel='LINKS_TO' group by dst"))
def hub_scores(q: Inputs) -> DataFrame:
    return R.hub_scores(stored(q, "edge"))


@query("select l_partkey part, count(distinct o_custkey) hub from lineitem join orders on l_orderkey=o_orderkey group by 1")
def hub_scores_relational(q: Inputs) -> DataFrame:
    joined = q.lineitem.select("l_orderkey", "l_partkey").join(q.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("o_custkey").alias("hub"))
