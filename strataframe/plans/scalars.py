"""Queries of scalar functions, links, images and conversion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import security as S
from ..functions import text as T
from ..operators import convert as V
from ..operators import maintain as M
from ..operators import rank as R
from ..operators import thoughts as N
from .registry import query
from .views import Inputs, duck

_ASSETS = "select *, case when src like 'asset://%' then substring(src,9) when src like 'data:image/%' then concat('image.',regexp_extract(src,'^data:image/([a-z0-9]+)',1)) " \
    "else replace(regexp_extract(regexp_replace(src,'[?#].*$',''),'([^/]*)$',1),'%20',' ') end file from asset_ref"  # fmt: skip


def _named_assets(q: Inputs) -> DataFrame:
    return q.asset_ref.withColumn("file", I.file_name(F.col("src")))


@query(duck(f"select concept_id, idx, file from ({_ASSETS})"))
def image_filename(q: Inputs) -> DataFrame:
    return _named_assets(q).select("concept_id", "idx", "file")


@query(duck(f"select concept_id, idx, concat(file,' (image ',idx,' in ',regexp_extract(concept_id,'([^/]*)$',1),')') caption from ({_ASSETS})"))
def image_caption(q: Inputs) -> DataFrame:
    caption = I.fallback_caption(F.col("file"), F.col("idx"), F.col("concept_id"))
    return _named_assets(q).select("concept_id", "idx", caption.alias("caption"))


def _plan_sql(mode: str) -> str:
    omni = {"text": "false", "optional": "alt='' and has_data", "omni": "has_data"}[mode]
    return duck(f"""select concept_id, idx, route, case when route='text' then case when alt<>'' then alt else concat(file,' (image ',idx,' in ',regexp_extract(concept_id,'([^/]*)$',1),')') end end caption
 from (select *, case when {omni} then 'omni' else 'text' end route from ({_ASSETS}))""")


def _plan(q: Inputs, mode: str) -> DataFrame:
    alt, has = F.col("alt"), F.col("has_data")
    fallback = I.fallback_caption(F.col("file"), F.col("idx"), F.col("concept_id"))
    return _named_assets(q).select("concept_id", "idx", I.route(mode, alt, has).alias("route"), I.caption(mode, alt, has, fallback).alias("caption"))


@query(_plan_sql("text"))
def image_plan_text(q: Inputs) -> DataFrame:
    return _plan(q, "text")


@query(_plan_sql("optional"))
def image_plan_optional(q: Inputs) -> DataFrame:
    return _plan(q, "optional")


@query(_plan_sql("omni"))
def image_plan_omni(q: Inputs) -> DataFrame:
    return _plan(q, "omni")


@query(duck("""select case when concept_id is null then 0 else count(*) end total, count(*) filter (route='text') n_text, count(*) filter (route='omni') n_omni
 from (select concept_id, case when alt='' and has_data then 'omni' else 'text' end route from asset_ref) group by concept_id""".replace("case when concept_id is null then 0 else count(*) end total", "concept_id, count(*) total")))
def image_route_stats(q: Inputs) -> DataFrame:
    routed = _plan(q, "optional")
    return routed.groupBy("concept_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("route") == "text").alias("n_text"), F.count_if(F.col("route") == "omni").alias("n_omni")
    )


@query(duck("""select concept_id, idx, case when src like 'data:%' then 'application/octet-stream' when regexp_replace(src,'[?#].*$','') like '%.png' then 'image/png'
 when regexp_replace(src,'[?#].*$','') like '%.jpg' then 'image/jpeg' else 'application/octet-stream' end mime from asset_ref where src not like 'data:%'"""))
def image_mime(q: Inputs) -> DataFrame:
    rows = _named_assets(q).filter("src not like 'data:%'")
    return rows.select("concept_id", "idx", I.mime(I.data_bytes(F.col("src")), F.col("file")).alias("mime"))


@query(duck("select concept_id, idx, sha256(concat('text|',src)) hash from asset_ref"))
def image_content_hash(q: Inputs) -> DataFrame:
    return q.asset_ref.select("concept_id", "idx", I.content_hash(F.lit("text"), F.col("src")).alias("hash"))


@query(duck("""select doc_id, k, alt, src from (select doc_id, unnest([1,2]) k, unnest([concat('fig ',doc_id),'']) alt, unnest([concat('img/p',doc_id,'.png'), concat('https://h/',doc_id,'.jpg')]) src from documents)"""))
def image_refs(q: Inputs) -> DataFrame:
    body = F.concat(
        F.lit("text ![fig "), "doc_id", F.lit("](img/p"), "doc_id", F.lit(".png \"a title\") [no](x.md) ![](<https://h/"), "doc_id", F.lit(".jpg>) end")
    )
    found = q.documents.select("doc_id", F.posexplode(I.references(body)).alias("k", "r"))
    return found.select("doc_id", (F.col("k") + 1).alias("k"), "r.alt", "r.src")


@query(duck("select concept_id, idx, src, alt from asset_ref where concept_id=(select id from concept where doc_id=5)"))
def images_of_concept(q: Inputs) -> DataFrame:
    one = q.concept.filter("doc_id = 5").select(F.col("id").alias("concept_id"))
    return q.asset_ref.join(F.broadcast(one), "concept_id", "left_semi").select("concept_id", "idx", "src", "alt")


@query(duck("select distinct a.src asset, c.id, c.title from asset_ref a join concept c on c.id=a.concept_id where a.src like 'asset://%'"))
def concepts_of_asset(q: Inputs) -> DataFrame:
    used = q.asset_ref.filter("src like 'asset://%'").select(F.col("src").alias("asset"), F.col("concept_id").alias("id"))
    return used.join(q.concept.select("id", "title"), "id").distinct().select("asset", "id", "title")


@query(duck("""with o as (select concat(concept_id,'#',idx) id, sha256(src) h from asset_ref where doc_id%7<>0),
 n as (select concat(concept_id,'#',idx) id, sha256(case when doc_id%5=0 then concat(src,'x') else src end) h from asset_ref where doc_id%11<>0)
select coalesce(o.id,n.id) id, case when n.h is null then 'pruned' when o.h=n.h then 'reused' else 'embedded' end action from o full outer join n on o.id=n.id"""))
def image_reconcile(q: Inputs) -> DataFrame:
    key = F.concat("concept_id", F.lit("#"), "idx").alias("id")
    old = q.asset_ref.filter("doc_id % 7 <> 0").select(key, F.sha2("src", 256).alias("content_hash"))
    src = F.when(F.col("doc_id") % 5 == 0, F.concat("src", F.lit("x"))).otherwise(F.col("src"))
    new = q.asset_ref.filter("doc_id % 11 <> 0").select(key, F.sha2(src, 256).alias("content_hash"))
    return M.reconcile(old, new)


@query(duck("""select distinct source_id, t target from (select source_id, unnest([concat('a/doc_',target_doc), concat('doc_',target_doc)]) t from link_raw)"""))
def link_extract(q: Inputs) -> DataFrame:
    body = F.concat(F.lit("see [x](../a/doc_"), "target_doc", F.lit(".md) and [[ ./doc_"), "target_doc", F.lit(" ]]"))
    found = q.link_raw.select("source_id", F.explode(T.link_targets(body)).alias("target"))
    return found.distinct()


def _raw(q: Inputs) -> tuple[DataFrame, DataFrame]:
    known = q.concept.select(F.concat(F.lit("doc_"), "doc_id").alias("id"))
    return q.link_raw.select(F.col("source_id").alias("src"), F.concat(F.lit("doc_"), "target_doc").alias("target")), known


@query(duck("select distinct source_id src, concat('doc_',target_doc) dst from link_raw where target_doc in (select doc_id from concept)"))
def links_resolved(q: Inputs) -> DataFrame:
    return M.resolve_links(*_raw(q))[0]


@query(duck("select concat(source_id,'→',target_id) id, source_id, target_id from broken_link"))
def links_broken(q: Inputs) -> DataFrame:
    return M.resolve_links(*_raw(q))[1]


@query(duck("select source_id, target_id from broken_link where (substring(target_id,5)::bigint)%2=0"))
def links_repaired(q: Inputs) -> DataFrame:
    raw, known = _raw(q)
    broken = M.resolve_links(raw, known)[1]
    added = broken.select(F.col("target_id").alias("id")).filter(F.expr("cast(substring(id, 5) as bigint) % 2 = 0"))
    concepts = q.concept.select("id").union(added.distinct())
    return M.repaired(broken, concepts).select("source_id", "target_id")


@query("select conv_id, array_to_string(list_sort(list_distinct(['a','thought'] || [role,'a'])),',') tags, count(*) n from conversations group by all")
def tag_union(q: Inputs) -> DataFrame:
    tags = T.tag_union(F.array(F.lit("a"), F.lit("thought")), F.array("role", F.lit("a")))
    return q.conversations.groupBy("conv_id", F.array_join(tags, ",").alias("tags")).agg(F.count("*").alias("n"))


@query("select event_id, json_extract_string(props,'$.k') k, json_valid(props) ok from events")
def extra_roundtrip(q: Inputs) -> DataFrame:
    back = T.decoded_extra(F.col("props"))
    return q.events.select("event_id", F.get_json_object(back, "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@query("select event_id, strftime(ts,'%Y-%m-%d %H:%M:%S') stamp from events")
def iso_timestamp(q: Inputs) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return q.events.select("event_id", F.date_format(T.iso_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("select conv_id, turn, concat('thought_',substring(replace(lower(text),' ','_'),1,30)) slug from conversations")
def slug(q: Inputs) -> DataFrame:
    return q.conversations.select("conv_id", "turn", F.concat(F.lit("thought_"), T.slug(F.col("text"))).alias("slug"))


#: An address for each document, in and around each private block; the same in both dialects.
_ADDRESS = """case doc_id%12 when 0 then concat('10.',doc_id%256,'.0.1') when 1 then concat('172.',doc_id%48,'.1.2') when 2 then concat('192.',160+doc_id%16,'.3.4')
 when 3 then concat('100.',doc_id%256,'.5.6') when 4 then concat('169.',250+doc_id%6,'.7.8') when 5 then concat('198.',16+doc_id%6,'.9.1') when 6 then concat(200+doc_id%80,'.1.1.',doc_id%300)
 when 7 then concat('127.',doc_id%256,'.1.1') when 8 then concat(source,'.example.com') when 9 then 'localhost' when 10 then concat('192.0.',doc_id%4,'.7') else concat(doc_id%256,'.8.8.8') end"""


def _in_range_sql(host: str) -> str:
    number = f"(case when regexp_full_match({host},'(\\d{{1,3}}\\.){{3}}\\d{{1,3}}') and list_max(list_transform(string_split({host},'.'), lambda x: x::int))<256 then list_sum(list_transform([1,2,3,4], lambda k: string_split({host},'.')[k]::bigint*(256**(4-k))::bigint)) end)"
    tests = " or ".join(f"{number} between {low} and {high}" for low, high in map(S._bounds, S.PRIVATE))
    return f"(coalesce({tests},false) or {host} in ('localhost','localhost.localdomain','0.0.0.0','::1'))"


@query(f"select doc_id, host, {_in_range_sql('host')} private from (select doc_id, {_ADDRESS} host from documents)")
def private_ip(q: Inputs) -> DataFrame:
    hosts = q.documents.select("doc_id", F.expr(_ADDRESS).alias("host"))
    return hosts.select("doc_id", "host", S.is_private(F.col("host")).alias("private"))


@query("""select page_id, h, (h='example.com' or h like '%.example.com' or h='ththre.example.net') allowed
 from (select page_id, regexp_extract(lower(url),'^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)',1) h from pages)""")
def domain_allow(q: Inputs) -> DataFrame:
    host = S.host_of(F.col("url"))
    return q.pages.select("page_id", host.alias("h"), S.domain_allowed(host, ("*.example.com", "ththre.example.net")).alias("allowed"))


#: A source of another kind for each document; the same in both dialects.
_SOURCE = """case doc_id%12 when 0 then '' when 1 then concat('data:text/plain,',doc_id) when 2 then concat('file:///etc/',doc_id) when 3 then concat('../up',doc_id,'.png')
 when 4 then concat('/abs',doc_id,'.png') when 5 then concat('ftp://h/',doc_id) when 6 then concat('http://10.0.',doc_id%256,'.1/a.png') when 7 then concat('https://evilexample.com/',doc_id)
 when 8 then concat('HTTPS://cdn.Example.com/',doc_id) when 9 then concat('img/a..b',doc_id,'.png') when 10 then concat('data:image/png;base64,',doc_id) else concat('asset://img_',doc_id) end"""
_HOST_SQL = "regexp_extract(lower(src),'^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)',1)"


@query(duck(f"""with s as (select concat('doc_',doc_id) id, {_SOURCE} src from documents union all select concat('ref_',doc_id,'_',idx), src from asset_ref
  union all select concat('page_',page_id), url from pages), h as (select *, {_HOST_SQL} host from s)
select id, src, case when trim(coalesce(src,''))='' then 'empty' when lower(src) like 'data:image/%' then 'ok' when lower(src) like 'data:%' then 'not an image'
 when lower(src) like 'asset://%' then 'ok' when lower(src) like 'file:%' then 'file urls are refused'
 when not regexp_matches(src,'^[A-Za-z][A-Za-z0-9+.-]*:') then case when regexp_matches(src,'(^|/)\\.\\.(/|$)') or src like '/%' then 'outside the root' else 'ok' end
 when not regexp_matches(lower(src),'^https?://') then 'unknown scheme' when {_in_range_sql("host")} then 'private address'
 when not (host='example.com' or host like '%.example.com') then 'domain not allowed' else 'ok' end verdict from h"""))
def src_validation(q: Inputs) -> DataFrame:
    rows = q.documents.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.expr(_SOURCE).alias("src"))
    rows = rows.union(q.asset_ref.select(F.concat(F.lit("ref_"), "doc_id", F.lit("_"), "idx"), "src")).union(q.pages.select(F.concat(F.lit("page_"), "page_id"), "url"))
    return rows.select("id", "src", S.source_verdict(F.col("src"), ("*.example.com",), remote=True).alias("verdict"))


@query("""select doc_id, case when (m>30 and m>n*0.02) or (n<50 and doc_id%3>0) then 'heavy' else 'fast' end auto,
 case when (m>30 and m>n*0.02) or (n<50 and doc_id%3>0) then 'surgical' else 'fast' end surgical, m
 from (select doc_id, n_chars n, len(regexp_extract_all(translate(text,'éèêzkv','αΩ∫⨌𝐀→'),'[\\x{370}-\\x{3FF}\\x{2200}-\\x{22FF}\\x{2A00}-\\x{2AFF}\\x{27C0}-\\x{27EF}\\x{2980}-\\x{29FF}\\x{1D400}-\\x{1D7FF}]'))::int m from documents)""")
def page_routing(q: Inputs) -> DataFrame:
    maths = V.math_chars(F.translate("text", "éèêzkv", "αΩ∫⨌𝐀→"))
    pages = q.documents.select("doc_id", F.col("n_chars").alias("n"), maths.alias("m"), (F.col("doc_id") % 3).alias("images"))
    args = F.col("n"), F.col("m"), F.col("images")
    return pages.select("doc_id", V.route("auto", *args).alias("auto"), V.route("surgical", *args).alias("surgical"), "m")


@query("""select doc_id, len(regexp_extract_all(text,'(?m)[ \\t]+$'))::int md009, len(regexp_extract_all(text,'\\n{3,}'))::int md012, (not text like '%'||chr(10))::int md047 from documents""")
def lint_counts(q: Inputs) -> DataFrame:
    text = F.col("text")
    return q.documents.select("doc_id", T.trailing_blanks(text).alias("md009"), T.blank_runs(text).alias("md012"), T.no_final_newline(text).alias("md047"))


@query("""select doc_id, md5(concat(regexp_replace(regexp_replace(regexp_replace(text,'(?m)[ \\t]+$','','g'),'\\n{3,}',chr(10)||chr(10),'g'),'\\n+$',''),chr(10))) h from documents""")
def lint_fixed(q: Inputs) -> DataFrame:
    return q.documents.select("doc_id", F.md5(T.linted(F.col("text"))).alias("h"))


@query(duck("select doc_id, array_to_string(list_distinct(['a']) || [concat('img_',doc_id%10)],',') ids from (select distinct doc_id from asset_ref)").replace("list_distinct(['a']) || ", "['a'] || "))
def asset_mentions(q: Inputs) -> DataFrame:
    text = F.concat(F.lit("x asset://a y asset://img_"), F.col("doc_id") % 10, F.lit(" asset://a."))
    return q.asset_ref.select("doc_id").distinct().select("doc_id", F.array_join(T.asset_mentions(text), ",").alias("ids"))


@query("""select page, y, concat('```',chr(10),line,chr(10),'```') block from (select doc_id page, (k*10)::double y, concat('w',doc_id,' v',k) line from documents, (values (1),(2)) z(k)) where length(line)>4""")
def mono_blocks(q: Inputs) -> DataFrame:
    spans = q.documents.select(F.col("doc_id").alias("page"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k"))
    words = F.explode(F.array(F.struct(F.lit(1).alias("x"), F.concat(F.lit("w"), "page").alias("text")), F.struct(F.lit(2).alias("x"), F.concat(F.lit("v"), "k").alias("text"))))
    spans = spans.select("page", (F.col("k") * F.lit(10.0) + 0.01).alias("y"), words.alias("s")).select("page", "y", "s.x", "s.text")
    return V.monospace_blocks(spans)


@query("""select doc_id page, case when doc_id%2=0 then concat('![a](b.png) ',doc_id) else concat('t ',doc_id,chr(10),chr(10),'![](i',doc_id,'.png)') end as text from documents""")
def gallery(q: Inputs) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("![a](b.png) "), "doc_id")).otherwise(F.concat(F.lit("t "), "doc_id"))
    pages = q.documents.select(F.col("doc_id").alias("page"), text.alias("text"), F.array(F.concat(F.lit("i"), "doc_id", F.lit(".png"))).alias("images"))
    return V.with_gallery(pages).select("page", "text")


_LINTED = "concat(regexp_replace(regexp_replace(regexp_replace({x},'(?m)[ \\t]+$','','g'),'\\n{{3,}}',chr(10)||chr(10),'g'),'\\n+$',''),chr(10))"
_THOUGHT = """concat_ws(chr(10),'---',concat('title: "Thought: ',role,' ',conv_id,'"'),'type: thought','thought_type: reasoning',concat('topic: ',role,' ',conv_id),
 concat('tags: [thought, reasoning, ',role,' ',conv_id,']'),'created: 2024-05-01T00:00:00','---','',coalesce(text,''))"""


@query(f"""select concat('thought_',substring(replace(lower(concat(role,' ',conv_id)),' ','_'),1,30),'_20240501000000_',substring(sha256(text),1,6)) id,
 concat('Thought: ',role,' ',conv_id) title, concat('Reasoning about ',role,' ',conv_id) description,
 array_to_string(list_sort(list_distinct(['thought','reasoning',concat(role,' ',conv_id),'t'||turn])),',') tags, md5({_LINTED.format(x=_THOUGHT)}) body from conversations""")
def thoughts(q: Inputs) -> DataFrame:
    notes = q.conversations.select(
        F.lit(None).cast("string").alias("id"), F.concat_ws(" ", "role", "conv_id").alias("topic"), "text",
        F.array(F.concat(F.lit("t"), "turn")).alias("tags"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("at"),
    )
    return N.thoughts(notes).select("id", "title", "description", F.array_join("tags", ",").alias("tags"), F.md5("body").alias("body"))


@query(duck("""select id, k, v from (select id, unnest(['id','type','title','description','tags','doc','language']) k,
 unnest([id,type,title,description,concat('["',array_to_string(tags,'","'),'"]'),doc_id::varchar,substring(id,1,2)]) v from concept where doc_id=7)"""))
def concept_get(q: Inputs) -> DataFrame:
    extra = F.create_map(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("language"), F.substring("id", 1, 2))
    named = q.concept.filter("doc_id = 7").select("id", "type", "title", "description", "tags", extra.alias("extra"))
    return named.select("id", F.explode(M.properties(named)).alias("k", "v"))


@query(duck("select title from concept where id='en/src1/doc_1'"))
def concept_property(q: Inputs) -> DataFrame:
    return q.concept.filter("id = 'en/src1/doc_1'").select("title")


@query(duck("select id, title from concept where doc_id in (3,5,9,27)"))
def concepts_in_list(q: Inputs) -> DataFrame:
    return q.concept.filter(F.col("doc_id").isin(3, 5, 9, 27)).select("id", "title")


@query(duck("select id, md5(concat(title,' ',coalesce(description,''),' ',coalesce(body,''))) h from concept"))
def search_text(q: Inputs) -> DataFrame:
    return q.concept.select("id", F.md5(T.search_text(F.col("title"), F.col("description"), F.col("body"))).alias("h"))


@query(duck("select id, exists(select 1 from links_to where src=c.id) linked from concept c"))
def edge_exists(q: Inputs) -> DataFrame:
    out = q.links_to.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    return q.concept.select("id").join(out, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"))


@query(duck("select concept_id, idx, src from asset_ref"))
def link_src_only(q: Inputs) -> DataFrame:
    link = F.concat(F.lit("![a]("), "src", F.lit(" \"t\")"))
    return q.asset_ref.select("concept_id", "idx", T.link_source_only(link).alias("src"))


@query(duck("select id, substring(coalesce(description,''),1,200) short, case when length(description)>200 then concat(substring(description,1,200),'...') else description end dotted from concept"))
def truncations(q: Inputs) -> DataFrame:
    return q.concept.select("id", F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("short"), T.shortened(F.col("description"), 200).alias("dotted"))


@query(duck("select id from concept where type='note' and list_has_all(tags,['fr','unlabelled'])"))
def concepts_all_tags(q: Inputs) -> DataFrame:
    return q.concept.filter((F.col("type") == "note") & R.all_tags(F.col("tags"), ("fr", "unlabelled"))).select("id")
