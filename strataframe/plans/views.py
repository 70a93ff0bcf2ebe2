"""Inputs of the queries, derived from the driver's tables: the same views in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_CONCEPT = """select d.doc_id, concat(lang,'/',source,'/doc_',d.doc_id, case when d.doc_id%50=0 then '_index' else '' end) id,
 case d.doc_id%5 when 0 then 'chapter' when 1 then 'section' when 2 then 'note' when 3 then 'reference' else 'table' end type,
 concat('Doc ',d.doc_id) title, substring(text,1,240) description,
 {array_open}lang, case quality when 1 then 'good' when 0 then 'bad' else 'unlabelled' end{array_close} tags, text body
 from documents d left join labels l on d.doc_id=l.doc_id"""
_KIND = "case when length(col)<40 then 'Heading' when col like '%icense%' then 'Blockquote' else 'Paragraph' end block_type"
_TARGET = "case k when 1 then (doc_id*7+3)%(n+20) when 2 then (doc_id*doc_id+1)%(n+20) else 0 end target_doc"
_SOURCE = """case (doc_id+k)%4 when 0 then concat('img/p',doc_id,'_',k,'.png') when 1 then 'https://cdn.example.com/a%20b.jpg?v=2#f'
 when 2 then concat('asset://img_',doc_id%10) else 'data:image/png;base64,AAAA' end src,
 case when k%2=1 then concat('figure ',doc_id) else '' end alt, doc_id%2=0 has_data"""
_HASHES = """select concat(id,'.md') path, {sha}(concat(body, case when doc_id%10=0 then 'x' else '' end){bits}) hash, id concept_id from concept where doc_id%13<>0
 union all select concat('gone/src/doc_',k,'.md'), {sha}(cast(k as {text}){bits}), concat('gone/src/doc_',k) from """
_TOMB = """select concat('deleted_',event_id) id, concat('doc_',event_id) original_id, ts deleted_at, ts >= m - interval '24' hour recoverable
 from events cross join (select max(ts) m from events) where event_type='error'"""
_EDGE = """select 'CONTAINS' rel, {first} src, id dst, 'Directory' dst_label from directory where id like '%/%'
 union all select 'CONTAINS', concat({first},'/',{second}), id, 'Concept' from concept
 union all select 'LINKS_TO', src, dst, 'Concept' from links_to union all select 'PART_OF', parent_doc_id, chunk_id, 'Chunk' from chunk"""
_BOTH = {
    "links_to": "select distinct l.source_id src, c.id dst from link_raw l join concept c on c.doc_id=l.target_doc",
    "broken_link": "select distinct source_id, concat('doc_',target_doc) target_id from link_raw l where not exists (select 1 from concept c where c.doc_id=l.target_doc)",
    "tombstone": _TOMB,
}

SPARK = _BOTH | {
    "concept": _CONCEPT.format(array_open="array(", array_close=")"),
    "chunk": f"""select c.doc_id, concat(c.id,'#chunk:',pos) chunk_id, c.id parent_doc_id, cast(pos as bigint) chunk_index, col chunk_text, {_KIND}
 from concept c lateral view posexplode(split(body,'\\n')) p as pos,col""",
    "link_raw": f"""select doc_id, id source_id, k, {_TARGET}
 from concept cross join (select count(*) n from documents) cross join (select explode(sequence(1,3)) k) where k<3 or doc_id%9=0""",
    "directory": "select distinct array_join(slice(p,1,k),'/') id from (select split(id,'/') p from concept) lateral view explode(sequence(1,2)) z as k",
    "edge": _EDGE.format(first="element_at(split(id,'/'),1)", second="element_at(split(id,'/'),2)"),
    "asset_ref": f"select doc_id, id concept_id, k idx, {_SOURCE} from concept cross join (select explode(sequence(1,2)) k) where k<=doc_id%3",
    "snapshot_old": _HASHES.format(sha="sha2", bits=",256", text="string") + "(select explode(sequence(1,5)) k)",
    "snapshot_new": "select concat(id,'.md') path, sha2(body,256) hash, id concept_id from concept",
}
DUCK = _BOTH | {
    "concept": _CONCEPT.format(array_open="[", array_close="]"),
    "chunk": f"""select doc_id, id||'#chunk:'||pos chunk_id, id parent_doc_id, pos::bigint chunk_index, col chunk_text, {_KIND}
 from (select doc_id,id,unnest(string_split(body,chr(10))) col, generate_subscripts(string_split(body,chr(10)),1)-1 pos from concept)""",
    "link_raw": f"select doc_id, id source_id, k, {_TARGET} from concept, (select count(*) n from documents), (values (1),(2),(3)) z(k) where k<3 or doc_id%9=0",
    "directory": "select distinct array_to_string(p[1:k],'/') id from (select string_split(id,'/') p from concept), (values (1),(2)) z(k)",
    "edge": _EDGE.format(first="split_part(id,'/',1)", second="split_part(id,'/',2)"),
    "asset_ref": f"select doc_id, id concept_id, k idx, {_SOURCE} from concept, (values (1),(2)) z(k) where k<=doc_id%3",
    "snapshot_old": _HASHES.format(sha="sha256", bits="", text="varchar") + "(values (1),(2),(3),(4),(5)) z(k)",
    "snapshot_new": "select concat(id,'.md') path, sha256(body) hash, id concept_id from concept",
}


def _named(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"\b(?:from|join|,)\s+(\w+)\b", sql)) if w in SPARK or w in TABLES]


class Inputs:
    """The tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.fingerprint, self._made = spark, folder, None, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._made.setdefault(name, self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        if name not in SPARK:
            raise AttributeError(name)
        if name not in self._made:
            sql = SPARK[name]
            given = {n: getattr(self, n) for n in _named(sql)}
            for n in given:
                sql = re.sub(rf"\b(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
            self._made[name] = self.spark.sql(sql, **given)
        return self._made[name]


def duck(sql: str, recursive: bool = False) -> str:
    """A DuckDB query with the views that it names in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _named(text):
            if n in DUCK and n not in order:
                need(DUCK[n])
                order.append(n)

    need(sql)
    heads = [f"{n} as ({DUCK[n]})" for n in order]
    body = sql.strip()
    if body.lower().startswith("with "):
        heads.append(body[5:])
        return f"with {'recursive ' if recursive else ''}" + ",\n".join(heads)
    return (f"with {'recursive ' if recursive else ''}" + ",\n".join(heads) + "\n" if heads else "") + body
